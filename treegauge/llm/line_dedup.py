"""Line dedup by a deletion-neighbourhood join; DataFrame functions only.

Lines are cut at line feeds and normalised: lower case, white space to single spaces. A line goes when an
earlier line (by document id, nulls last, then line number) is equal to it or, for lines of
`edit_words` words and more, differs by one word: replaced, added or left out. Lines below `min_words` words are
never touched.

1. Equal lines are one: their earliest place stands for them. Sums before the shuffle keep hot lines cheap.
2. A lossless sieve: of two lines one word apart, the first or the last half of the words is equal (the
   half taken from the shorter line's length). Distinct lines whose halves nobody shares leave here.
3. The lines left are fetched and emit their deletion neighbourhood as hashed keys: the line itself and the line
   without its i-th word, for every i outside a half that has to be equal. A key is made from sums of hashes of neighbouring words, which change in a
   few terms when a word goes, so all keys of a line cost one pass over it.
4. Equal keys are joined through the key's earliest line only. That loses nothing: lines that agree
   without the word at the same place are all one word apart from each other, and a line that agrees whole with others'
   shortened forms is the only one of its kind. Hot keys are summed before the shuffle and never expanded into pairs.
5. Every match is verified on the words themselves.

Null and empty texts have no lines to lose. Repeated rows of a document hold the same line at the same
place, which is one line: neither loses it to the other. Several texts under one id are put in the order of their text hash. Extra
columns are kept by `drop_duplicate_lines` and not read otherwise. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treegauge.llm.common import chosen, unused_name, written

MIN_WORDS = 5
EDIT_WORDS = 10
#: Size of the broadcast set that spares documents without sieved lines the shuffle.
BUCKETS = 1 << 20

_BLANKS = r"[ \t\x0B\f\r]{2,}|[\t\x0B\f\r]"


def normalised(line: Column) -> Column:
    """Lower case, white space to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(line), _BLANKS, " "))


def _n_words(norm: Column) -> Column:
    """Words of a normalised line."""
    return F.octet_length(norm) - F.octet_length(F.replace(norm, F.lit(" "), F.lit(""))) + 1


def _place() -> Column:
    """Where a line stands; the order of places is the order of 'earlier'."""
    return F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("doc_id"), F.col("content").alias("content"),
                    F.col("line_no").alias("line_no"))


def lines_of(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, content, line_no, norm, words): lines of at least `min_words` words.

    The text is normalised as a whole, which leaves line feeds alone, so nothing is computed twice for a line.
    """
    clean = F.regexp_replace(F.lower("text"), _BLANKS, " ")
    return (
        docs.where("text is not null")
        .select("doc_id", F.xxhash64("text").alias("content"), F.posexplode(F.split(clean, "\n")).alias("line_no", "line"))
        .select("doc_id", "content", "line_no", F.trim("line").alias("norm"))
        .withColumn("words", _n_words(F.col("norm"))).where((F.col("norm") != "") & (F.col("words") >= min_words))
    )


def _halves(norm: Column, words: Column) -> Column:
    """Keys of the halves: for partners of the same length or one longer, and for partners one shorter."""
    keys = []
    for base in (words, words - 1):
        half = F.floor(base / 2).cast("int")
        keys += [F.xxhash64(F.lit("first"), base, F.call_function("substring_index", norm, F.lit(" "), half)),
                 F.xxhash64(F.lit("last"), base, F.call_function("substring_index", norm, F.lit(" "), -half))]
    return F.array(*keys)


def _term(*words: Column) -> Column:
    """A hash of neighbouring words, small enough for exact sums of millions."""
    return F.shiftright(F.xxhash64(*words), 24)


def word_hashes(words: Column) -> Column:
    """Hashes of the words with two marks before and behind, which `neighbourhood` reads by index."""
    ends = F.array(F.lit("\n"), F.lit("\n")), F.array(F.lit("\r"), F.lit("\r"))
    return F.transform(F.concat(ends[0], words, ends[1]), lambda w: F.xxhash64(w))


def whole_sum(hashes: Column, n: Column) -> Column:
    """The sum of the hashes of three words in a row."""
    return F.aggregate(F.sequence(F.lit(1), n + 2), F.lit(0).cast("bigint"), lambda s, i: s + _term(
        F.get(hashes, i - 1), F.get(hashes, i), F.get(hashes, i + 1)))


def neighbourhood(lines: DataFrame) -> DataFrame:
    """(place, gone, key, indel): keys of every line (gone 0) and of the line without its gone-th word.

    Words go from the halves that need not be equal. A shortened line meets whole lines (indel) and lines shortened at
    the same place (not indel).
    """

    def trio(*at: int) -> Column:
        return _term(*[F.get("hashes", F.col("gone") + 1 + k) for k in at])

    half = F.floor((F.col("n") - 1) / 2).cast("int")
    lowest = F.when(F.col("last_shared"), 1).otherwise(half + 1)
    highest = F.when(F.col("first_shared"), F.col("n")).otherwise(F.col("n") - half)
    change = trio(-2, -1, 1) + trio(-1, 1, 2) - trio(-2, -1, 0) - trio(-1, 0, 1) - trio(0, 1, 2)
    whole = lines.select("place", F.lit(0).alias("gone"), F.xxhash64("whole", "n", F.lit(0)).alias("key"), F.lit(True).alias("indel"))
    shortened = (
        lines.select("place", "whole", "hashes", "n", F.explode(F.sequence(lowest, highest)).alias("gone"))
        .select("place", "gone", "n", (F.col("whole") + change).alias("total"))
        .select("place", "gone", "n", "total", F.explode(F.array(F.lit(0), F.col("gone"))).alias("kind"))
        .select("place", "gone", F.xxhash64("total", F.col("n") - 1, "kind").alias("key"), (F.col("kind") == 0).alias("indel"))
    )
    return whole.union(shortened)


def _hashes() -> list[Column]:
    return [F.xxhash64("norm").alias("h1"), F.xxhash64(F.lit("2"), "norm").alias("h2")]


def occurrences_of(docs: DataFrame, min_words: int) -> DataFrame:
    """A row a line: where it stands, hashes, number of words, half keys. The one pass over all texts."""
    return lines_of(docs, min_words).select(
        "doc_id", "content", "line_no", *_hashes(), "words", _halves(F.col("norm"), F.col("words")).alias("halves"))


def sieve(occurrences: DataFrame, edit_words: int) -> DataFrame:
    """Distinct lines that share a half with another one: h1, h2, earliest place, which halves are shared."""
    distinct = (
        occurrences.where(F.col("words") >= edit_words - 1).groupBy("h1", "h2")
        .agg(F.min(_place()).alias("place"), F.first("halves").alias("halves"))
    )
    halves = distinct.select("h1", "h2", F.posexplode("halves").alias("which", "half"))
    shared = halves.groupBy("half").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").select("half")
    first = F.col("which") % 2 == 0
    keep = halves.join(shared, "half", "left_semi").groupBy("h1", "h2").agg(
        F.max(first).alias("first_shared"), F.max(~first).alias("last_shared"))
    return distinct.select("h1", "h2", "place").join(keep, ["h1", "h2"])


def _fetched(docs: DataFrame, left: DataFrame) -> DataFrame:
    """The words of sieved lines, taken from the documents their earliest places name.

    A broadcast set of `BUCKETS` hash buckets at most keeps documents without such lines out of the shuffle.
    """
    places = left.select("h1", "h2", "place", "first_shared", "last_shared", F.col("place.doc_id").alias("p_id"),
                         F.col("place.content").alias("p_content"), F.col("place.line_no").alias("line_no"))
    wanted = places.groupBy("p_id", "p_content").agg(
        F.collect_list(F.struct("line_no", "h1", "h2", "place", "first_shared", "last_shared")).alias("lines"))
    bucket = F.pmod(F.xxhash64("doc_id", "content"), F.lit(BUCKETS)).cast("int").alias("bucket")
    named = F.broadcast(wanted.select(F.col("p_id").alias("doc_id"), F.col("p_content").alias("content")).select(bucket).distinct())
    texts = (
        docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("content"), "text")
        .withColumn("bucket", bucket).join(named, "bucket", "left_semi")
    )
    words = F.split("norm", " ")
    return (
        wanted.join(texts, F.col("p_content").eqNullSafe(F.col("content")) & F.col("p_id").eqNullSafe(F.col("doc_id")))
        .select(F.split("text", "\n").alias("all"), F.explode("lines").alias("l"))
        .select("l.*", normalised(F.get("all", F.col("l.line_no"))).alias("norm")).drop("line_no")
        .select("h1", "h2", "place", "first_shared", "last_shared", words.alias("w"), word_hashes(words).alias("hashes"))
        .dropDuplicates(["h1", "h2"])
        .select("*", F.size("w").alias("n"), whole_sum(F.col("hashes"), F.size("w")).alias("whole"))
    )


def _one_apart() -> Column:
    """Whether arrays w and e_w differ by exactly one word."""
    def without(longer: str, shorter: str, gone: str) -> Column:
        rest = F.concat(F.slice(longer, F.lit(1), F.col(gone) - 1), F.slice(longer, F.col(gone) + 1, F.size(longer)))
        return (F.col(gone) > 0) & (rest == F.col(shorter))

    n, m = F.size("w"), F.size("e_w")
    swapped = F.size(F.filter(F.zip_with("w", "e_w", lambda x, y: x != y), lambda different: different)) == 1
    return F.when(n == m, swapped).when(n == m + 1, without("w", "e_w", "gone")).when(m == n + 1, without("e_w", "w", "e_gone")).otherwise(False)


def edited_lines(docs: DataFrame, left: DataFrame, edit_words: int) -> DataFrame:
    """(h1, h2, earliest): distinct lines with an earlier line one word apart."""
    lines = written(_fetched(docs, left), "lines")
    keys = neighbourhood(lines)
    # swaps: all lines under a key are one word apart, the earliest serves the rest.
    # added or left out: the whole line of the key is one word from every shortened one; others are not compared.
    entry = F.struct("place", "gone")
    heads = keys.groupBy("key", "indel").agg(
        F.count("*").alias("n"), F.min(F.when(~F.col("indel"), entry)).alias("swap"),
        F.min(F.when(F.col("indel") & (F.col("gone") == 0), entry)).alias("whole"),
        F.min(F.when(F.col("indel") & (F.col("gone") > 0), entry)).alias("shortened")).where("n > 1")
    met = keys.join(heads, ["key", "indel"])
    other = F.when(~F.col("indel"), F.col("swap")).when(F.col("gone") == 0, F.col("shortened")).otherwise(F.col("whole"))
    pairs = (
        met.select("place", "gone", other.alias("e")).where(F.col("e").isNotNull() & (F.col("e.place") < F.col("place")))
        .select(F.col("place").alias("p"), "gone", F.col("e.place").alias("earliest"), F.col("e.gone").alias("e_gone")).distinct()
    )
    verified = (
        pairs.join(lines.select("h1", "h2", "place", "w"), F.col("p") == F.col("place")).drop("place")
        .join(lines.select("place", F.col("w").alias("e_w")), F.col("earliest") == F.col("place"))
        .where((F.greatest(F.size("w"), F.size("e_w")) >= edit_words) & _one_apart())
    )
    return verified.groupBy("h1", "h2").agg(F.min("earliest").alias("earliest"))


def duplicate_lines(docs: DataFrame, min_words: int = MIN_WORDS, edit_words: int = EDIT_WORDS, doc_id: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """The lines that go: doc_id, content, line_no, first_doc_id, first_line_no, edits (0 or 1).

    The line named is the earliest equal one (edits 0) or else the earliest one word apart (edits 1).
    """
    rows = chosen(docs, doc_id=doc_id, text=text)
    occurrences = written(occurrences_of(rows, min_words), "line-places")
    edited = written(edited_lines(rows, written(sieve(occurrences, edit_words), "sieved"), edit_words), "edited")
    places = occurrences.select("doc_id", "content", "line_no", "h1", "h2", _place().alias("place")).distinct()
    firsts = (occurrences.groupBy("h1", "h2").agg(F.min(_place()).alias("first")).join(edited, ["h1", "h2"], "left"))
    copy = F.col("first") < F.col("place")
    source = F.when(copy, F.col("first")).otherwise(F.col("earliest"))
    return (
        places.join(firsts, ["h1", "h2"]).where(copy | F.col("earliest").isNotNull())
        .select("doc_id", "content", "line_no", source.alias("s"), F.when(copy, 0).otherwise(1).alias("edits"))
        .select("doc_id", "content", "line_no", F.col("s.doc_id").alias("first_doc_id"), F.col("s.line_no").alias("first_line_no"), "edits")
    )


def drop_duplicate_lines(docs: DataFrame, min_words: int = MIN_WORDS, edit_words: int = EDIT_WORDS, doc_id: str = "doc_id",
                         text: str = "text") -> DataFrame:
    """docs, all rows and columns, with the lines of `duplicate_lines` taken out of the text."""
    id_, content, lines = (unused_name(docs.columns, name) for name in ("_gone_id", "_gone_content", "_gone_lines"))
    gone = written(duplicate_lines(docs, min_words, edit_words, doc_id, text), "gone-lines").groupBy("doc_id", "content").agg(
        F.collect_set("line_no").alias(lines)).withColumnsRenamed({"doc_id": id_, "content": content})
    body = F.col(f"`{text}`")
    kept = F.filter(F.split(body, "\n"), lambda _, i: ~F.array_contains(lines, i))
    joined = docs.join(gone, F.xxhash64(body).eqNullSafe(F.col(content)) & F.col(f"`{doc_id}`").eqNullSafe(F.col(id_)), "left")
    new = F.when(F.col(lines).isNull(), body).otherwise(F.array_join(kept, "\n"))
    return joined.select(*[new.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])


SQL = rf"""
WITH rows AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
cut AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS line_no, unnest(ls) AS line FROM
  (SELECT doc_id, string_split(text, chr(10)) AS ls FROM rows)),
normed AS (SELECT doc_id, line_no, trim(regexp_replace(lower(line), '[ \t\x0B\f\r]{{2,}}|[\t\x0B\f\r]', ' ', 'g'), ' ') AS norm FROM cut),
lines AS (SELECT *, length(norm) - length(replace(norm, ' ', '')) + 1 AS words FROM normed WHERE norm <> ''),
long AS (SELECT * FROM lines WHERE words >= {MIN_WORDS}),
firsts AS (SELECT norm, any_value(words) AS words, min((doc_id, line_no)) AS place FROM long GROUP BY norm),
split AS (SELECT norm, words, place, string_split(norm, ' ') AS w FROM firsts WHERE words >= {EDIT_WORDS} - 1),
shortened AS (SELECT norm, words, place, g, array_to_string(list_concat(w[1:g - 1], w[g + 1:]), ' ') AS rest FROM
  (SELECT *, unnest(range(1, words + 1)) AS g FROM split)),
swaps AS (SELECT a.norm, min(b.place) AS earliest FROM shortened a JOIN shortened b ON a.rest = b.rest AND a.g = b.g AND a.words = b.words
  WHERE b.place < a.place AND a.words >= {EDIT_WORDS} GROUP BY a.norm),
gaps AS (SELECT a.norm, min(b.place) AS earliest FROM shortened a JOIN split b ON a.rest = b.norm WHERE b.place < a.place AND a.words >= {EDIT_WORDS} GROUP BY a.norm),
adds AS (SELECT b.norm, min(a.place) AS earliest FROM shortened a JOIN split b ON a.rest = b.norm WHERE a.place < b.place AND a.words >= {EDIT_WORDS} GROUP BY b.norm),
edited AS (SELECT norm, min(earliest) AS earliest FROM (FROM swaps UNION ALL FROM gaps UNION ALL FROM adds) GROUP BY norm),
judged AS (SELECT l.doc_id, l.line_no, CASE WHEN f.place < (l.doc_id, l.line_no) THEN f.place ELSE e.earliest END AS s,
  CASE WHEN f.place < (l.doc_id, l.line_no) THEN 0 ELSE 1 END AS edits
  FROM long l JOIN firsts f USING (norm) LEFT JOIN edited e USING (norm))
SELECT doc_id, CAST(line_no AS INT) AS line_no, s[1] AS first_doc_id, CAST(s[2] AS INT) AS first_line_no, CAST(edits AS INT) AS edits
FROM judged WHERE s IS NOT NULL
"""
