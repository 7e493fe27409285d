"""Source-tree metrics on Spark: tables of file versions in, metric, match and view tables out."""

__version__ = "0.1.0"
