"""User-written Python analyzers: a small Arrow UDF runs the code, Spark does the rest."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treegauge.functions.tags import CATEGORY, METRIC, merge_tags, tag_literal
from treegauge.operators.analyzers import FILE_KEYS, runs_on
from treegauge.operators.guarded import Guard, packed
from treegauge.operators.matches import MATCH_COLUMNS
from treegauge.specs import PythonAnalyzer, ScanRules

# The exchange format of user analyzers.
MATCH_TYPE = (
    "struct<line_number:int,column_start:int,column_end:int,matched_text:string,"
    "context_before:string,context_after:string>"
)
OUTPUT_TYPE = (
    "array<struct<value:double,tags:map<string,string>,metric_key:string,category:string,"
    f"matches:array<{MATCH_TYPE}>>>"
)


def analyzer_input(path: Column, content: Column, change_type: Column) -> Column:
    """One file as the JSON text that external analyzers read."""
    return F.to_json(
        F.struct(
            path.alias("file_path"), content.alias("content"), change_type.alias("change_type")
        )
    )


def parse_analyzer_output(text: Column) -> Column:
    """Analyzer output as an array of entries; empty when the text is malformed, is no list, or
    any entry lacks its value."""
    parsed = F.when(F.ltrim(text).startswith("["), F.from_json(text, OUTPUT_TYPE))
    bad = F.exists(parsed, lambda e: e.isNull() | e["value"].isNull())
    empty = F.array().cast(OUTPUT_TYPE)
    return F.coalesce(F.when(~bad, parsed), empty)


def entry_tags(entry: Column, overrides: dict[str, str] | None = None) -> Column:
    """Tags of an output entry: its tags, then metric_key and category, then the overrides."""
    fields = F.array(
        F.struct(F.lit(METRIC).alias("key"), entry["metric_key"].alias("value")),
        F.struct(F.lit(CATEGORY).alias("key"), entry["category"].alias("value")),
    )
    legacy = F.map_from_entries(F.filter(fields, lambda f: f["value"].isNotNull()))
    own = F.coalesce(entry["tags"], tag_literal({}))
    return merge_tags(merge_tags(own, legacy), tag_literal(overrides or {}))


# Results are handed on after so many files, or characters of output.
SLICE_FILES, SLICE_CHARS = 256, 1 << 20
RESULT_TYPE = pa.list_(pa.struct([("number", pa.int32()), ("side", pa.string()), ("output", pa.string()), ("error", pa.string())]))


def _runner(analyzers: list[PythonAnalyzer]):
    """Arrow UDF around user code: for each analyzer and side whose content is given, output text or an error message.

    All analyzers of a file run in one call, in one child process of the task (`Guard`). Texts leave their Arrow batch one
    at a time and results go back in slices, so beside the batch a worker holds one file and one slice, however
    many files the task has.
    """
    code, limits = packed([a.func for a in analyzers]), [a.time_limit for a in analyzers]
    result_type, most_files, most_chars = RESULT_TYPE, SLICE_FILES, SLICE_CHARS

    @F.arrow_udf("array<struct<number:int,side:string,output:string,error:string>>")
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        with Guard(code) as guard:
            for batch in batches:
                out, chars = [], 0
                for values in zip(*batch):
                    old_path, path, old, new, change_type, numbers = (v.as_py() for v in values)
                    results = []
                    for k in numbers:
                        for side, name, content in (("before", old_path, old), ("after", path, new)):
                            if content is not None:
                                output, error = guard.call(k, (name, content, change_type), limits[k])
                                error = None if error is None else f"{name}: {error}"
                                results.append({"number": k, "side": side, "output": output, "error": error})
                                chars += len(output or error)
                    out.append(results)
                    if len(out) >= most_files or chars >= most_chars:
                        yield pa.array(out, result_type)
                        out, chars = [], 0
                del batch, values
                if out:
                    yield pa.array(out, result_type)

    return run


def run_user_analyzers(
    file_changes: DataFrame, analyzers: Iterable[PythonAnalyzer], rules: ScanRules
) -> DataFrame:
    """Raw results, one row per file, side and analyzer: parsed entries, or an error.

    All analyzers run in one pass over the changes. The user code sees whole texts. It runs in a child process of each task:
    an exception, the end of that process, or a call beyond the analyzer's time limit loses only its own file,
    side and analyzer. Write the result out before taking several of metrics, matches and errors from it, or the
    code runs once for each.
    """
    analyzers = list(analyzers)
    fits = [F.when(runs_on(a, rules), F.lit(k)) for k, a in enumerate(analyzers)]
    chosen = F.filter(F.array(*fits), lambda k: k.isNotNull())
    old_path = F.coalesce("old_file_path", "file_path")
    wanted = F.size(chosen) > 0
    results = _runner(analyzers)(
        old_path, "file_path", F.when(wanted, F.col("old_content")), F.when(wanted, F.col("content")), "change_type", chosen)
    one = F.col("_r")
    ids = F.array(*[F.lit(a.analyzer_id) for a in analyzers])
    overrides = F.array(*[tag_literal(a.tags).cast("map<string,string>") for a in analyzers])
    return (
        file_changes.select(*FILE_KEYS, F.explode(results).alias("_r"))
        .select(*FILE_KEYS, ids[one["number"]].alias("analyzer_id"), one["side"].alias("side"), one["error"].alias("error"),
                overrides[one["number"]].alias("overrides"), parse_analyzer_output(one["output"]).alias("entries"))
    )


def user_entries(results: DataFrame) -> DataFrame:
    """One-sided metric entries in emission order, for `metrics.merge_before_after`."""
    return results.select(
        *FILE_KEYS, "analyzer_id", "side", "overrides", F.posexplode("entries").alias("seq", "e")
    ).select(
        *FILE_KEYS,
        "analyzer_id",
        merge_tags(entry_tags(F.col("e")), F.col("overrides")).alias("tags"),
        F.lit(None).cast("string").alias("scope"),
        "side",
        "seq",
        F.col("e.value").alias("value"),
    )


def user_matches(results: DataFrame) -> DataFrame:
    """Match rows; file and analyzer are those of the run, whatever the user code wrote."""
    path = F.when(
        F.col("side") == "before", F.coalesce("old_file_path", "file_path")
    ).otherwise(F.col("file_path"))
    lists = F.transform("entries", lambda e: F.coalesce(e["matches"], F.array().cast(f"array<{MATCH_TYPE}>")))
    return results.select(
        "scan_id", path.alias("file_path"), "analyzer_id", "side", F.inline(F.flatten(lists))
    ).select(*MATCH_COLUMNS, "side")


def user_errors(results: DataFrame) -> DataFrame:
    """One row per failed run: '<path>: <message>'."""
    return results.where("error IS NOT NULL").select("scan_id", "analyzer_id", "side", "error")
