"""Sorting files into stacks and leaving files out, by path alone."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treegauge.functions.paths import extension, matches_any_glob
from treegauge.specs import ScanRules


def tech_stack(path: Column, rules: ScanRules) -> Column:
    """Name of the first stack that accepts the path, else NULL: one CASE, no join."""
    ext = extension(path)
    chain = None
    for stack in rules.stacks:
        conditions = [ext.isin(list(stack.extensions))]
        if stack.paths:
            conditions.append(matches_any_glob(path, stack.paths))
        if stack.excludes:
            conditions.append(~matches_any_glob(path, stack.excludes))
        accepted = reduce(and_, conditions)
        name = F.lit(stack.name)
        chain = F.when(accepted, name) if chain is None else chain.when(accepted, name)
    return F.lit(None).cast("string") if chain is None else chain


def is_excluded(path: Column, rules: ScanRules) -> Column:
    """True where a global exclude glob hits and no stack of that extension names the path."""
    ext = extension(path)
    named = [
        ext.isin(list(stack.extensions)) & matches_any_glob(path, stack.paths)
        for stack in rules.stacks
        if stack.paths
    ]
    excluded = matches_any_glob(path, rules.global_excludes)
    return excluded & ~reduce(or_, named) if named else excluded


def classify(files: DataFrame, rules: ScanRules) -> DataFrame:
    """Kept files with their tech_stack; narrow."""
    path = F.col("file_path")
    return files.where(~is_excluded(path, rules)).withColumn("tech_stack", tech_stack(path, rules))
