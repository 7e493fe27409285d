"""Pairing deleted with added files of one project.

Every step numbers the files of a group and joins equal numbers, so a group of n copies costs n
rows, not n*n pairs, and no task holds a whole group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treegauge.functions.ranking import salted_row_number
from treegauge.operators.path_filter import maybe_of_paths
from treegauge.session import cut_lineage

KEY = ["project", "file_path"]
PAIR = ["project", "old_path", "new_path"]
LINE = ["project", "line"]
GROUP = [*LINE, "old_class", "new_class"]
# Least Jaccard similarities as fractions, taken in turn: close copies pair first.
LEVELS = ((4, 5), (1, 2))
# Partners that a file meets per group in one round, at most; more rounds follow.
ROUND_SHIFTS = 64
# Sets up to this size are a class each; above it a class spans a twenty-fifth of its sizes.
EXACT_CLASSES, CLASS_STEP = 24, 1.04
# Buckets of the line counts that bound how many lines two sets can have in common.
SIGNATURE = 32


def _pair_by_number(deleted: DataFrame, added: DataFrame, group: list[str]) -> DataFrame:
    """The i-th deleted with the i-th added file of each group."""
    old = salted_row_number(deleted, group, "old_path", "_rn")
    new = salted_row_number(added, group, "new_path", "_rn")
    return old.join(new, [*group, "_rn"]).drop("_rn")


def exact_pairs(changed: DataFrame) -> DataFrame:
    """Deleted and added files of equal content, one to one: (project, digest, old_path, new_path).

    Undecodable files without a digest pair with nothing.
    """
    deleted = changed.where("change_type = 'D' AND old_digest IS NOT NULL").select(
        "project", F.col("old_digest").alias("digest"), F.col("file_path").alias("old_path")
    )
    added = changed.where("change_type = 'A' AND new_digest IS NOT NULL").select(
        "project", F.col("new_digest").alias("digest"), F.col("file_path").alias("new_path")
    )
    return _pair_by_number(deleted, added, ["project", "digest"])


def _line_hashes(content: Column) -> Column:
    lines = F.filter(F.split(content, r"\r?\n", -1), lambda line: F.trim(line) != "")
    return F.array_distinct(F.transform(lines, lambda line: F.xxhash64(F.trim(line))))


def _rarest_first(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides as (project, path, lines, size, signature).

    `lines` are those that the other side holds, too, in one order for all files: lines of the fewest changed files
    first. `size` counts all lines of the file; the signature counts the shared ones by bucket of their hash.
    """
    both = reduce(DataFrame.unionByName, [
        side.select("project", F.lit(path).alias("_side"), F.col(path).alias("_path"), F.size("lines").alias("size"),
                    F.explode("lines").alias("line"))
        for side, path in ((old, "old_path"), (new, "new_path"))
    ])
    holders = both.groupBy(*LINE).agg(F.count("*").alias("_n"), F.min("_side").alias("_a"), F.max("_side").alias("_b"))
    shared = holders.where("_a <> _b").select(*LINE, "_n")
    buckets = F.transform(F.sequence(F.lit(0), F.lit(SIGNATURE - 1)), lambda b: F.size(
        F.filter("lines", lambda line: F.pmod(line, F.lit(SIGNATURE)) == b)).cast("smallint"))
    ordered = cut_lineage(
        both.join(shared, LINE)
        .groupBy("project", "_side", "_path", "size")
        .agg(F.sort_array(F.collect_list(F.struct("_n", "line"))).alias("_l"))
        .select("project", "_side", "_path", "size", F.col("_l.line").alias("lines"))
        .withColumn("signature", buckets)
    )

    def side(path: str) -> DataFrame:
        return ordered.where(F.col("_side") == path).select("project", F.col("_path").alias(path), "lines", "size", "signature")

    return side("old_path"), side("new_path")


def _size_class(size: Column) -> Column:
    steps = F.floor(F.log(size / EXACT_CLASSES) / F.log(F.lit(CLASS_STEP))) + 1
    return F.when(size <= EXACT_CLASSES, size).otherwise(EXACT_CLASSES + steps).cast("int")


def _prefix(files: DataFrame, path: str, level: tuple[int, int], own_class: str) -> DataFrame:
    """The files under each line at which a partner may first be met.

    At a line with r shared lines from it on, a partner of b lines that has nothing rarer in common shares r lines at most,
    and a pair of a and b lines needs num / (num + den) of a + b. That bounds b by `most`; similarity alone bounds it
    from below by `least`. Lines where no size is left are not listed: the file is not met there.
    """
    num, den = level
    rows = files.select("project", path, "size", "signature", F.size("lines").alias("_k"), F.posexplode("lines").alias("_at", "line"))
    rows = rows.withColumn("most", F.least(
        F.floor((F.col("_k") - F.col("_at")) * (num + den) / num) - F.col("size"), F.floor(F.col("size") * den / num)).cast("int"))
    rows = rows.withColumn("least", F.ceil(F.col("size") * num / den).cast("int")).where("most >= least")
    return rows.withColumn(own_class, _size_class(F.col("size"))).drop("_k", "_at")


def _cells(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Sizes and bounds of the files of one side that stand together."""
    return rows.groupBy(*keys).agg(F.min("size").alias(f"_{name}_min"), F.max("size").alias(f"_{name}_max"), F.max("most").alias(f"_{name}_most"))


def _can_meet(rows: DataFrame, cells: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Rows for which the cell of the other side may hold a partner, by size both ways."""
    found = rows.join(cells, keys).where(
        (F.col(f"_{name}_min") <= F.col("most")) & (F.col(f"_{name}_max") >= F.col("least")) & (F.col("size") <= F.col(f"_{name}_most")))
    return found.drop(f"_{name}_min", f"_{name}_max", f"_{name}_most")


def _groups(old: DataFrame, new: DataFrame, level: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """The files of both sides by group: a line, and a class of sizes on either side that can be alike when they first meet there.

    Two sets of this similarity meet in the group of the first line that they have in common. Files that only share
    lines near the end of their order (a header that everyone has) meet nowhere.
    """
    old_rows, new_rows = _prefix(old, "old_path", level, "old_class"), _prefix(new, "new_path", level, "new_class")
    old_rows = _can_meet(old_rows, _cells(new_rows, [*LINE, "new_class"], "new"), LINE, "new")
    new_rows = cut_lineage(_can_meet(new_rows, _cells(old_rows, GROUP, "old"), [*LINE, "new_class"], "old"))
    old_rows = cut_lineage(_can_meet(old_rows, _cells(new_rows, GROUP, "new"), GROUP, "new"))
    return old_rows, new_rows


def _numbered(old_rows: DataFrame, new_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides numbered within their group, with the size of its larger side as `span`; one-sided groups go."""
    sides = [(old_rows, "old_path"), (new_rows, "new_path")]
    counts = [side.groupBy(*GROUP).agg(F.count("*").alias(f"_{path}")) for side, path in sides]
    spans = counts[0].join(counts[1], GROUP).select(*GROUP, F.greatest("_old_path", "_new_path").alias("span"))
    numbered = [cut_lineage(salted_row_number(side.join(spans, GROUP), GROUP, path, "i")) for side, path in sides]
    return numbered[0], numbered[1]


def _met(old_rows: DataFrame, new_rows: DataFrame, keys: list[str], level: tuple[int, int]) -> DataFrame:
    """Candidates: rows of equal keys that may be alike by both sizes and by their signatures, once a pair."""
    num, den = level
    names = ("size", "signature", "most", "least")
    new_rows = new_rows.select(*keys, "new_path", *[F.col(n).alias(f"_{n}") for n in names])
    in_common = F.aggregate(F.zip_with("signature", "_signature", lambda a, b: F.least(a, b).cast("int")), F.lit(0), lambda total, n: total + n)
    fits = F.col("_size").between(F.col("least"), F.col("most")) & F.col("size").between(F.col("_least"), F.col("_most"))
    enough = in_common * (num + den) >= (F.col("size") + F.col("_size")) * num
    met = old_rows.select(*keys, "old_path", *names).join(new_rows, keys).where(fits).where(enough)
    return met.groupBy(*PAIR).agg(F.count("*").alias("met"))


def _meetings(old_rows: DataFrame, new_rows: DataFrame, first: int, shifts: int, level: tuple[int, int]) -> DataFrame:
    """Candidates among the i-th old and the (i + shift)-th new file of a group, for `shifts` shifts from `first` on."""
    last = F.least(F.lit(first + shifts).cast("bigint"), F.col("span")) - 1
    shifted = old_rows.where(F.col("span") > first).withColumn(
        "_shift", F.explode(F.sequence(F.lit(first).cast("bigint"), last))
    )
    placed = shifted.withColumn("i", (F.col("i") - 1 + F.col("_shift")) % F.col("span") + 1)
    return _met(placed, new_rows, [*GROUP, "i"], level)


def _alike(pairs: DataFrame, old: DataFrame, new: DataFrame, level: tuple[int, int]) -> DataFrame:
    """The pairs whose whole line sets reach the level, with their Jaccard similarity."""
    num, den = level
    common = F.size(F.array_intersect("_a", "_b"))
    both = (
        pairs.join(old.select("project", "old_path", F.col("lines").alias("_a"), F.col("size").alias("_m")), ["project", "old_path"])
        .join(new.select("project", "new_path", F.col("lines").alias("_b"), F.col("size").alias("_n")), ["project", "new_path"])
        .select(*PAIR, common.alias("_common"), (F.col("_m") + F.col("_n") - common).alias("_union"))
    )
    return both.where(F.col("_common") * den >= F.col("_union") * num).select(
        *PAIR, (F.col("_common") / F.col("_union")).alias("score")
    )


def _unused(rows: DataFrame, pairs: DataFrame, *paths: str) -> DataFrame:
    """Rows none of whose files is part of a pair."""
    for path in paths:
        rows = rows.join(pairs.select("project", path), ["project", path], "left_anti")
    return rows


def _one_to_one(scored: DataFrame) -> list[DataFrame]:
    """Pairs that are the best left for both of their files, until no pair is left.

    All pairs stand in one order, by similarity and then by a hash, so the first one left is always taken.
    """
    rank = F.struct("score", F.xxhash64("old_path", "new_path").alias("_tie"), "old_path", "new_path")
    left, taken = cut_lineage(scored.select("project", "old_path", "new_path", rank.alias("rank"))), []
    while not left.isEmpty():
        best = [
            left.groupBy("project", path).agg(F.max("rank").alias("rank")).select("project", "rank.old_path", "rank.new_path")
            for path in ("old_path", "new_path")
        ]
        taken.append(cut_lineage(best[0].join(best[1], PAIR)))
        left = cut_lineage(_unused(left, taken[-1], "old_path", "new_path"))
    return taken


def _line_sets(changed: DataFrame, base: DataFrame, target: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The line sets of deleted and of added files; only hashes of lines are shuffled, never content."""

    def side(change_type: str, files: DataFrame, path: str) -> DataFrame:
        alone = changed.where(F.col("change_type") == change_type).select(*KEY)
        texts = maybe_of_paths(files.select(*KEY, "content"), alone, KEY)
        named = alone.join(texts.hint("merge"), KEY).where(F.col("content").isNotNull())
        return cut_lineage(named.select("project", F.col("file_path").alias(path), _line_hashes(F.col("content")).alias("lines")))

    changed = cut_lineage(changed)
    return _rarest_first(side("D", base, "old_path"), side("A", target, "new_path"))


def candidate_pairs(old: DataFrame, new: DataFrame, level: tuple[int, int] = LEVELS[-1]) -> DataFrame:
    """Pairs of ordered line sets that are left to verify, with the number of groups they met in."""
    return _met(*_groups(old, new, level), GROUP, level)


def alike_pairs(changed: DataFrame, base: DataFrame, target: DataFrame, level: tuple[int, int] = LEVELS[-1]) -> DataFrame:
    """Every deleted with every added file whose line sets are this similar: (project, old_path, new_path, score).

    A set-similarity join: prefixes of the rarest lines, filtered by size, position and signature, candidates counted once a
    pair and then verified on whole sets. The result itself is as large as there are alike pairs.
    """
    old, new = _line_sets(changed, base, target)
    return _alike(candidate_pairs(old, new, level), old, new, level)


def similar_pairs(changed: DataFrame, base: DataFrame, target: DataFrame) -> DataFrame:
    """Deleted and added files that share at least half of their lines, one to one.

    Complete: of the files left over, no two are alike enough. Candidates meet in the groups of the
    set-similarity join (`_groups`); in a group the i-th old file meets the (i + shift)-th new one, shift after
    shift, until one side of the group is used up. A round is linear in the files left, so families of near copies are
    used up in the first ones without all their pairs, and files that share a header only are in no group together.
    """
    old, new = _line_sets(changed, base, target)
    found = [old.select("project", "old_path", F.lit("").alias("new_path")).limit(0)]
    for level in LEVELS:
        old_rows, new_rows = _numbered(*_groups(old, new, level))
        first = 0
        while True:
            old_rows = old_rows.where(F.col("span") > first)
            old_rows = cut_lineage(old_rows.join(new_rows.select(*GROUP).distinct(), GROUP, "left_semi"))
            if old_rows.isEmpty():
                break
            shifts = min(max(first, 1), ROUND_SHIFTS)
            taken = _one_to_one(_alike(_meetings(old_rows, new_rows, first, shifts, level), old, new, level))
            first += shifts
            if taken:
                found += taken
                pairs = reduce(DataFrame.unionByName, taken)
                old_rows = _unused(old_rows, pairs, "old_path")
                new_rows = cut_lineage(_unused(new_rows, pairs, "new_path"))
                old = cut_lineage(_unused(old, pairs, "old_path"))
                new = cut_lineage(_unused(new, pairs, "new_path"))
    return reduce(DataFrame.unionByName, found)
