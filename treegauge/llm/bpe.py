"""BPE encoding and decoding with reuse of content-defined chunks.

Texts are cut where a rolling hash of the last 16 bytes before a word has `CUT_BITS` zero bits, so equal
passages get equal chunks wherever they stand. A chunk that several texts hold is encoded once:
1. Chunk hashes are counted over all texts (hashes only are shuffled). Those met at least twice go into
   a Bloom filter of fixed size (`FILTER_BITS`), which is broadcast. A false hit costs a detour, never a wrong id.
2. One pass over the texts encodes chunks that nobody shares, where words are what can be reused: each distinct word
   once. It leaves references to shared ones. Joins of chunks are checked there: the last and first words around a join are encoded together, which must
   give what the two chunks end and begin with. Where it does not, the chunks become one that is encoded anew as one text, and
   its own joins are checked again, until all agree. Texts without references are finished there and then.
3. Shared chunks are encoded once, as one text each, and joined to the references; texts are put together and
   finished. Equal texts are put together once.

Ids, and their decoding, are exactly those of the tokenizer for the whole text without special tokens added. That
takes a tokenizer that drops ASCII white space and never looks across it, and decodes by spaces (`misfit` tests
it on the driver). Tokenizers that do not fit encode and decode whole texts (`encode_whole`).

Null and empty texts have no tokens and decode to the empty text. Null ids, ties and repeated rows are kept row by row.
Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treegauge.llm.common import chosen, written

#: One word start in 2^CUT_BITS is a cut: chunks of about 1,600 bytes.
CUT_BITS = 8
FILTER_BITS = 1 << 25
_PROBES = 4
_BATCH_BYTES = 4_000_000
#: A chunk ends after so many words at the latest.
MOST_WORDS = 4096
#: So many bytes of chunks are encoded in one call, as the library holds much more for them.
_CALL_BYTES = 1 << 18
#: A task remembers so many digests that it has passed on; a full memory starts anew, and repeats are dropped later.
_SENT = 200_000
#: Word starts are hashed over so many bytes at a time, as each byte takes several words of eight bytes.
_HASHED_BYTES = 1 << 18
#: A process remembers the ids of so many words.
_REMEMBERED = 300_000

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

_PASS = ("kind int, doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, text_key binary, "
         "parts array<struct<ref:binary,ids:binary>>, chunk binary")


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    names = [tokenizer.id_to_token(i).encode() if tokenizer.id_to_token(i) is not None else b"" for i in range(tokenizer.get_vocab_size())]
    return tokenizer, names


def misfit(path: str) -> str | None:
    """Why texts cannot be cut at white space for this tokenizer (None: they can)."""
    with open(path, encoding="utf-8") as f:
        given = json.load(f)
    tokenizer = _tokenizer(path)[0]
    if given.get("decoder") is not None:
        return "it has a decoder of its own"
    if given["model"].get("dropout"):
        return "it drops merges at random"
    normalizer = given.get("normalizer")
    steps = [] if normalizer is None else normalizer.get("normalizers", [normalizer])
    spaces = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
    if any(step != spaces and step["type"] not in ("NFC", "Lowercase") for step in steps):
        return "its normalizer may look across white space"
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or len(t["content"].split()) != 1 or t["content"].strip() != t["content"]
           for t in given.get("added_tokens", [])):
        return "its added tokens take or look at white space"
    if tokenizer.pre_tokenizer is None:
        return "it does not split at white space"
    signs = [chr(c) for c in range(33, 127)] + ["\u00e9", "\u0301", "\u4e2d", "\u0663", "\u20ac"]

    def pieces(text: str) -> list[str]:
        return [piece for piece, _ in tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    alone = {sign: pieces(sign) for sign in signs}
    for left in signs:
        for right in signs:
            if pieces(f"{left} {right}") != alone[left] + alone[right]:
                return f"it looks across the space between {left!r} and {right!r}"
    return None


def text_ids(path: str, texts: list[bytes]) -> list[np.ndarray]:
    """Ids of each text, encoded some at a time."""
    out: list[np.ndarray] = []
    begin = held = 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= _CALL_BYTES or i == len(texts) - 1:
            out += word_ids(path, texts[begin:i + 1])
            begin, held = i + 1, 0
    return out


#: Any character outside a range in which NFC changes nothing, lower case goes sign by sign, and only the space is white.
_NOT_PLAIN = re.compile("[^ -~\u00a1-\u00ff\u2010-\u2027\u2030-\u205e\u20ac]")


@functools.lru_cache(maxsize=2)
def _normalized_tokenizer(path: str):
    """The tokenizer for texts that are normalised already, whether that takes lower case, and its added tokens."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        given = json.load(f)
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    tokenizer.normalizer = None
    normalizer = given.get("normalizer") or {"normalizers": []}
    lowers = any(step["type"] == "Lowercase" for step in normalizer.get("normalizers", [normalizer]))
    return tokenizer, lowers, [t["content"].lower() for t in given.get("added_tokens", [])]


def word_ids(path: str, words: list[bytes]) -> list[np.ndarray]:
    """Ids of each word, or of words with one space between, alone.

    The normalizer takes a good part of the time; texts of plain signs are normalised here, the others by the tokenizer.
    """
    bare, lowers, added = _normalized_tokenizer(path)
    texts = [w.decode() for w in words]
    plain, other = {}, {}
    for i, text in enumerate(texts):
        low = text.lower()
        if _NOT_PLAIN.search(text) or any(token in low for token in added):
            other[i] = text
        else:
            plain[i] = low if lowers else text
    out: list[np.ndarray] = [np.zeros(0, dtype=np.uint32)] * len(texts)
    for tokenizer, some in ((bare, plain), (_tokenizer(path)[0], other)):
        for i, e in zip(some, tokenizer.encode_batch_fast(list(some.values()), add_special_tokens=False)):
            out[i] = np.array(e.ids, dtype=np.uint32)
    return out


class WordMemory:
    """Ids of words alone, as bytes, across the batches of a process; a full memory starts anew."""

    def __init__(self, path: str, most: int = _REMEMBERED):
        self.path, self.most = path, most
        self.held: dict[bytes, bytes] = {}

    def ids(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of each word, four bytes an id."""
        held = self.held
        found = {w: held[w] for w in words if w in held}
        missing = [w for w in words if w not in found]
        new = {w: ids.tobytes() for w, ids in zip(missing, word_ids(self.path, missing))}
        if len(held) + len(new) > self.most:
            held.clear()
        held.update(itertools.islice(new.items(), self.most))
        found.update(new)
        return found


@functools.lru_cache(maxsize=2)
def _memory(path: str) -> WordMemory:
    return WordMemory(path)


def cut_marks(data: np.ndarray, starts: np.ndarray, cut_bits: int) -> np.ndarray:
    """For each word start of a byte array, whether the 16 bytes before it ask for a cut."""
    out = np.zeros(len(starts), dtype=bool)
    for begin in range(0, len(data), _HASHED_BYTES):
        first, last = np.searchsorted(starts, [begin, begin + _HASHED_BYTES])
        back = min(begin, 16)
        out[first:last] = _block_marks(data[begin - back:begin + _HASHED_BYTES], starts[first:last] - (begin - back), cut_bits)
    return out


def _block_marks(data: np.ndarray, starts: np.ndarray, cut_bits: int) -> np.ndarray:
    rolled, base = data.astype(np.uint64) + np.uint64(1), 0x9E3779B97F4A7C15
    for width in (1, 2, 4, 8):
        moved = np.zeros_like(rolled)
        moved[width:] = rolled[:-width]
        rolled = rolled + moved * np.uint64(base)
        base = base * base % 2**64
    at = rolled[np.maximum(starts - 1, 0)]
    at = (at ^ (at >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (at >> np.uint64(64 - cut_bits)) == 0


class Batch:
    """Some texts: their words in a row, and the chunks that the words fall into."""

    def __init__(self, texts: list[bytes], cut_bits: int):
        joined = b"\n".join(texts)
        data = np.frombuffer(joined, dtype=np.uint8)
        blank = _SPACE[data]
        before = np.concatenate([[True], blank[:-1]]) if len(data) else np.zeros(0, dtype=bool)
        self.words = joined.split()
        starts = np.flatnonzero(~blank & before)
        offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        self.first_word = np.searchsorted(starts, offsets)  # of each text, and one more
        begins = cut_marks(data, starts, cut_bits) & (starts - offsets[np.searchsorted(offsets, starts, side="right") - 1] >= 16) if len(
            starts) else np.zeros(0, dtype=bool)
        heads = self.first_word[:-1][np.diff(self.first_word) > 0]
        begins[heads] = True
        marks = np.flatnonzero(begins)
        for mark, after in zip(marks.tolist(), np.append(marks[1:], len(self.words)).tolist()):
            if after - mark > MOST_WORDS:
                begins[mark:after:MOST_WORDS] = True
        self.chunk_word = np.flatnonzero(begins)  # first word of each chunk
        self.text_of = np.searchsorted(self.first_word, self.chunk_word, side="right") - 1
        ends = np.append(self.chunk_word[1:], len(self.words))
        self.spans = list(zip(self.chunk_word.tolist(), ends.tolist()))

    def chunk(self, i: int) -> bytes:
        """The words of a chunk, one space between."""
        a, b = self.spans[i]
        return b" ".join(self.words[a:b])


def _digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def _batches(part: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, list[bytes]]]:
    begin = held = 0
    texts: list[bytes] = []
    for i, text in enumerate(part["text"]):
        texts.append(text.encode() if isinstance(text, str) else b"")
        held += len(texts[-1])
        if held >= _BATCH_BYTES or i == len(part) - 1:
            yield part.iloc[begin:i + 1], texts
            begin, held, texts = i + 1, 0, []


def chunk_filter(source: DataFrame, cut_bits: int, bits: int) -> np.ndarray:
    """Bits of a Bloom filter over the chunks that at least two texts (or places) hold; of fixed size."""

    def hashes(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for _, texts in _batches(part):
                batch = Batch(texts, cut_bits)
                keys = [int.from_bytes(_digest(batch.chunk(i))[:8], "little", signed=True) for i in range(len(batch.spans))]
                key, n = np.unique(np.array(keys, dtype=np.int64), return_counts=True)
                yield pd.DataFrame({"key": key, "n": n})

    shared = source.select("text").mapInPandas(hashes, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1")
    probes = F.array(*[F.shiftright("key", 8 * i).bitwiseAND(F.lit(bits - 1)) for i in range(_PROBES)])
    blocks = (
        shared.select(F.explode(probes).alias("bit")).select(F.shiftright("bit", 15).cast("int").alias("block"), F.col("bit").bitwiseAND(F.lit(32767)).alias("at"))
        .groupBy("block").agg(F.bitmap_construct_agg("at").alias("bits"))
    )
    out = np.zeros((bits // 32768, 4096), dtype=np.uint8)
    for row in blocks.collect():  # 4 KB a block, bits / 8 bytes in all
        out[row["block"]] = np.frombuffer(bytes(row["bits"]), dtype=np.uint8)
    return out.reshape(-1).view("<u4")


def _maybe_shared(table: np.ndarray, digests: list[bytes]) -> np.ndarray:
    keys = np.frombuffer(b"".join(d[:8] for d in digests), dtype=np.int64) if digests else np.zeros(0, dtype=np.int64)
    hit = np.ones(len(keys), dtype=bool)
    for i in range(_PROBES):
        bit = (keys >> (8 * i)) & (len(table) * 32 - 1)
        hit &= (table[bit >> 5] >> (bit & 31).astype(np.uint32)) & 1 == 1
    return hit


def _pack(ids: np.ndarray) -> bytes:
    """Ids as bytes, two for each where they fit; the first byte tells."""
    small = not len(ids) or int(ids.max()) < 1 << 16
    return bytes([small]) + ids.astype("<u2" if small else "<u4").tobytes()


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype="<u2" if data[0] else "<u4", offset=1).astype("<u4")


def _finish(path: str, ids: np.ndarray) -> tuple[int, str, str]:
    names = _tokenizer(path)[1]
    decoded = b" ".join([names[i] for i in ids.tolist()])
    return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest()


def joins_agree(path: str, lefts: list[bytes], rights: list[bytes], ids: dict[bytes, bytes]) -> np.ndarray:
    """Whether two words around a join are encoded together as they are alone."""
    windows, place = {}, []
    for a, b in zip(lefts, rights):
        place.append(windows.setdefault((a, b), len(windows)))
    together = word_ids(path, [a + b" " + b for a, b in windows])
    same = np.array([t.tobytes() == ids[a] + ids[b] for (a, b), t in zip(windows, together)], dtype=bool)
    return same[place] if place else np.zeros(0, dtype=bool)


def edges_agree(ids: np.ndarray, first: bytes, last: bytes) -> tuple[bool, bool]:
    """Whether the ids of a chunk begin and end with those of its first and last words."""
    n, m = len(first) // 4, len(last) // 4
    return ids[:n].tobytes() == first, ids[len(ids) - m:].tobytes() == last


def _encode_pass(path: str, cut_bits: int, table):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sent: set[bytes] = set()  # what this task has passed on already, by digest
        for part in parts:
            for rows, texts in _batches(part):
                yield pd.DataFrame(_encode_batch(path, cut_bits, table.value, rows["doc_id"].tolist(), texts, sent),
                                   columns=["kind", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "text_key", "parts", "chunk"]
                                   ).astype({"doc_id": "Int64", "n_tokens": "Int64"})
                if len(sent) > _SENT:
                    sent.clear()

    return run


def ids_by_words(path: str, batch: Batch, which: list[int]) -> list[np.ndarray]:
    """Ids of chunks, put together from those of their words; each distinct word is encoded once."""
    words = [word for i in which for word in batch.words[slice(*batch.spans[i])]]
    codes, kinds = pd.factorize(np.array([*words, None], dtype=object)[:-1])
    alone = _memory(path).ids(kinds.tolist())
    sizes = np.array([len(alone[word]) // 4 for word in kinds], dtype=np.int64)
    begins = np.cumsum(sizes) - sizes
    size = sizes[codes]
    ends = np.cumsum(size)
    flat = np.frombuffer(b"".join([alone[word] for word in kinds]), dtype=np.uint32)
    ids = flat[np.repeat(begins[codes] - (ends - size), size) + np.arange(size.sum())]
    last = np.cumsum([batch.spans[i][1] - batch.spans[i][0] for i in which], dtype=np.int64) - 1
    return np.split(ids, ends[last])[:-1]


def mended_units(path: str, batch: Batch, chunks: list[bytes], shared: np.ndarray,
                 by_words: bool = False) -> tuple[list[tuple[int, int]], list[np.ndarray | None]]:
    """Runs of chunks whose joins all agree, and the ids of each; None for a single chunk that others share.

    With `by_words`, chunks start as the ids of their words; those that need mending are encoded as one text.
    """
    units = [(i, i + 1) for i in range(len(chunks))]
    known: dict[tuple[int, int], np.ndarray] = {}
    own = np.flatnonzero(~shared).tolist() if by_words else []
    if own:
        known.update(zip([units[i] for i in own], ids_by_words(path, batch, own)))
    agreed: set[tuple[tuple[int, int], tuple[int, int]]] = set()  # by the units on both sides
    while True:
        open_ = [(a, b) for a, b in units if (a, b) not in known and not (b == a + 1 and shared[a])]
        wanted = {u: chunks[u[0]] if u[1] == u[0] + 1 else b" ".join(chunks[u[0]:u[1]]) for u in open_}
        distinct = list(dict.fromkeys(wanted.values()))
        encoded = dict(zip(distinct, text_ids(path, distinct)))
        known.update((u, encoded[text]) for u, text in wanted.items())
        joins = [(u, v) for u, v in zip(units, units[1:]) if batch.text_of[u[0]] == batch.text_of[v[0]] and (u, v) not in agreed]
        lefts = [batch.words[batch.spans[u[1] - 1][1] - 1] for u, _ in joins]
        rights = [batch.words[batch.spans[v[0]][0]] for _, v in joins]
        alone = _memory(path).ids(list(dict.fromkeys(lefts + rights)))
        same = joins_agree(path, lefts, rights, alone)
        broken = set()
        for (u, v), left, right, ok in zip(joins, lefts, rights, same.tolist()):
            ok = ok and (u not in known or edges_agree(known[u], b"", alone[left])[1]) and (v not in known or edges_agree(known[v], alone[right], b"")[0])
            if ok:
                agreed.add((u, v))
            else:
                broken.add(v[0])
        if not broken:
            return units, [known.get(u) for u in units]
        mended: list[tuple[int, int]] = []
        for a, b in units:
            if a in broken:
                mended[-1] = (mended[-1][0], b)
            else:
                mended.append((a, b))
        units = mended


def _encode_batch(path: str, cut_bits: int, table: np.ndarray, doc_ids: list, texts: list[bytes], sent: set[bytes]) -> list[tuple]:
    batch = Batch(texts, cut_bits)
    chunks = [batch.chunk(i) for i in range(len(batch.spans))]
    digests = [_digest(c) for c in chunks]
    units, ids_of = mended_units(path, batch, chunks, _maybe_shared(table, digests), by_words=True)
    out: list[tuple] = []
    first_unit = np.searchsorted(batch.text_of[[a for a, _ in units]] if units else np.zeros(0), np.arange(len(texts) + 1))
    for t, text in enumerate(texts):
        parts: list[tuple] = []
        held: list[np.ndarray] = []
        for k in range(first_unit[t], first_unit[t + 1]):
            if ids_of[k] is not None:
                held.append(ids_of[k])
                continue
            if held:
                parts.append((None, np.concatenate(held)))
                held = []
            i = units[k][0]
            parts.append((digests[i], None))
            if digests[i] not in sent:
                sent.add(digests[i])
                out.append((2, None, None, None, None, digests[i], None, chunks[i]))
        if held:
            parts.append((None, np.concatenate(held)))
        if all(ref is None for ref, _ in parts):
            ids = parts[0][1] if parts else np.zeros(0, dtype=np.uint32)
            out.append((0, doc_ids[t], *_finish(path, ids), None, None, None))
            continue
        key = _digest(text)
        out.append((1, doc_ids[t], None, None, None, key, None, None))
        if b"text" + key not in sent:  # a text of one chunk has that chunk's digest
            sent.add(b"text" + key)
            out.append((3, None, None, None, None, key, [
                {"ref": ref, "ids": None if ids is None else _pack(ids)} for ref, ids in parts], None))
    return out


def _encode_chunks(path: str):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for begin in range(0, len(part), 2000):
                rows = part.iloc[begin:begin + 2000]
                texts = [bytes(c) for c in rows["chunk"]]
                ends = [(text.split(b" ", 1)[0], text.rsplit(b" ", 1)[-1]) for text in texts]
                alone = _memory(path).ids(list({word for pair in ends for word in pair}))
                packed = []
                for ids, (first, last) in zip(text_ids(path, texts), ends):
                    if edges_agree(ids, alone[first], alone[last]) != (True, True):
                        raise ValueError(f"{path}: the ends of a chunk are not encoded as alone, so its joins are unproven")
                    packed.append(_pack(ids))
                yield pd.DataFrame({"ref": rows["text_key"].to_numpy(), "ids": packed})

    return run


def _assemble(path: str):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            done = []
            for key, parts_, given in zip(part["text_key"], part["parts"], part["given"]):
                named = {p["pos"]: p["ids"] for p in given}
                ids = np.concatenate([_unpack(bytes(p["ids"] if p["ids"] is not None else named[k])) for k, p in enumerate(parts_)])
                done.append((key, *_finish(path, ids)))
            yield pd.DataFrame(done, columns=["k", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode_whole(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """As `encode_documents`, text by text without chunks: for tokenizers that look across white space."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = _tokenizer(tokenizer_path)[0]
        for part in parts:
            done = []
            for id_, text in zip(part["doc_id"].tolist(), part["text"]):
                ids = tokenizer.encode(text if isinstance(text, str) else "", add_special_tokens=False).ids
                decoded = tokenizer.decode(ids, skip_special_tokens=False).encode()
                done.append((id_, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest()))
            yield pd.DataFrame(done, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]).astype({"doc_id": "Int64"})

    source = chosen(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_documents(docs: DataFrame, tokenizer_path: str, cut_bits: int = CUT_BITS, filter_bits: int = FILTER_BITS,
                     doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    if misfit(tokenizer_path) is not None:
        return encode_whole(docs, tokenizer_path, doc_id, text)
    spark = docs.sparkSession
    source = chosen(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    table = spark.sparkContext.broadcast(chunk_filter(source, cut_bits, filter_bits))
    passed = written(source.mapInPandas(_encode_pass(tokenizer_path, cut_bits, table), _PASS), "encoded")
    digest = ["n_tokens", "ids_sha256", "decoded_sha256"]
    chunks = passed.where("kind = 2").groupBy("text_key").agg(F.first("chunk").alias("chunk"))
    encoded = chunks.mapInPandas(_encode_chunks(tokenizer_path), "ref binary, ids binary")
    stored = passed.where("kind = 3").select("text_key", "parts")
    given = (
        stored.select("text_key", F.posexplode("parts.ref").alias("pos", "ref")).where("ref is not null").dropDuplicates(["text_key", "pos"])
        .join(encoded, "ref").groupBy("text_key").agg(F.collect_list(F.struct("pos", "ids")).alias("given"))
        .withColumnRenamed("text_key", "given_key")
    )
    whole = stored.dropDuplicates(["text_key"]).join(given, F.col("text_key") == F.col("given_key")).select("text_key", "parts", "given")
    put = whole.mapInPandas(_assemble(tokenizer_path), "k binary, n_tokens long, ids_sha256 string, decoded_sha256 string")
    open_ = passed.where("kind = 1").select("doc_id", "text_key").join(put, F.col("text_key") == F.col("k"))
    return passed.where("kind = 0").select("doc_id", *digest).union(open_.select("doc_id", *digest))
