"""Problem 6: encoding of the whole corpus with a public byte-level BPE vocabulary.

Method: global distinct-word shuffle.  Texts are cut into pre-tokens by the vocabulary's pattern and those into
*words* at every place that no vocabulary entry spans (a merge can never cross it, so cutting there changes no id;
in scripts whose letters are mostly entries of their own this leaves very few distinct words).  Each block of
documents keeps its words' order as numbers into its own word list (positions exploded, in packed form); the word
lists are reduced to the distinct words of the corpus, each is encoded once, its ids are joined back to the lists and
put in place by position.  Decoding joins the token-byte table.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fumikura.plans.blocks import by_group

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Characters of a block of documents (a longer document is a block of its own).
BLOCK_CHARS = 1_000_000
#: The code points with the White_Space property.
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: What follows an apostrophe to make a pre-token of its own.
_CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
LETTER, NUMBER, SPACE, MISC = 0, 1, 2, 3

_state: dict = {}


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


def _classes() -> np.ndarray:
    """Class of every code point."""
    if "classes" not in _state:
        import regex

        cp = np.full(0x110000, MISC, np.uint8)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for pattern, k in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
            for m in regex.finditer(pattern, every):
                a, b = ord(m[0][0]), ord(m[0][-1])
                cp[a : b + 1] = k
        cp[_WHITE] = SPACE
        cp[0xD800:0xE000] = MISC
        _state["classes"] = cp
    return _state["classes"]


def pretoken_starts(cp: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Flags of code points at which a pre-token begins; ``doc`` numbers the documents the code points are of.

    The pattern's alternatives in order: contractions, letters, numbers, other marks (each run with one blank before
    it), white space but its last character before something else, white space.
    """
    n = len(cp)
    k = _classes()[cp]
    new_doc = np.ones(n, bool)
    new_doc[1:] = doc[1:] != doc[:-1]
    change = new_doc.copy()
    change[1:] |= k[1:] != k[:-1]
    start = change.copy()
    space = k == SPACE
    # the last white-space character before something else stands alone, and a blank there goes to what follows
    before = np.zeros(n, bool)
    before[:-1] = space[:-1] & ~space[1:] & ~new_doc[1:]
    start |= before
    at = np.flatnonzero(before)
    joined = at[cp[at] == 32] + 1
    start[joined] = False
    # an apostrophe that begins a run of marks by itself, with the letters after it
    free = np.zeros(n, bool)
    free[:-1] = (cp[:-1] == 39) & start[:-1] & (k[1:] == LETTER) & ~new_doc[1:]
    for p in np.flatnonzero(free):
        for c in _CONTRACTIONS:
            m = len(c)
            if p + m < n and doc[p + m] == doc[p] and all(cp[p + 1 + j] == ord(x) for j, x in enumerate(c)):
                start[p + 1] = False
                if p + 1 + m < n:
                    start[p + 1 + m] = True
                break
    return start


class Vocabulary:
    """Byte ranks, an encoder of single words, and where no entry can span two characters."""

    def __init__(self, path: str):
        import tiktoken

        self.ranks = ranks(path)
        enc = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=self.ranks, special_tokens={})
        self.encode = enc._core_bpe.encode_single_piece
        pairs: dict[bytes, set[bytes]] = {}
        for t in self.ranks:
            if len(t) > 1:
                for i in range(1, len(t)):
                    if t[i] & 0xC0 != 0x80:  # a character begins here
                        a = i - 1
                        while a > 0 and t[a] & 0xC0 == 0x80:
                            a -= 1
                        b = i + 1
                        while b < len(t) and t[b] & 0xC0 == 0x80:
                            b += 1
                        pairs.setdefault(t[a:i], set()).add(t[i:b])
        rights = sorted({r for s in pairs.values() for r in s})
        self.right_no = {r: j for j, r in enumerate(rights)}
        self.left = {a: np.array([self.right_no[r] for r in s]) for a, s in pairs.items()}
        self.left_class = np.full(0x110000, -1, np.int32)
        self.right_class = np.full(0x110000, -1, np.int32)
        self.left_sets: list[frozenset] = []
        self.right_sets: list[frozenset] = []
        self._l: dict[frozenset, int] = {}
        self._r: dict[frozenset, int] = {}
        self.spans = np.zeros((0, 0), bool)

    def _learn(self, chars: np.ndarray) -> None:
        for c in chars.tolist():
            b = chr(c).encode("utf-8", "surrogatepass")
            ls = frozenset(b[j:] for j in range(len(b)) if b[j:] in self.left)
            rs = frozenset(b[: j + 1] for j in range(len(b)) if b[: j + 1] in self.right_no)
            if ls not in self._l:
                self._l[ls] = len(self.left_sets)
                self.left_sets.append(ls)
            if rs not in self._r:
                self._r[rs] = len(self.right_sets)
                self.right_sets.append(rs)
            self.left_class[c], self.right_class[c] = self._l[ls], self._r[rs]
        member = np.zeros((len(self.right_sets), len(self.right_no)), bool)
        for j, rs in enumerate(self.right_sets):
            member[j, [self.right_no[r] for r in rs]] = True
        self.spans = np.zeros((len(self.left_sets), len(self.right_sets)), bool)
        for j, ls in enumerate(self.left_sets):
            hit = np.unique(np.concatenate([self.left[a] for a in ls])) if ls else np.zeros(0, int)
            self.spans[j] = member[:, hit].any(axis=1)

    def joined(self, cp: np.ndarray) -> np.ndarray:
        """For each code point but the first: may an entry span it and the one before?"""
        seen = np.unique(cp)
        new = seen[self.left_class[seen] < 0]
        if len(new):
            self._learn(new)
        return self.spans[self.left_class[cp[:-1]], self.right_class[cp[1:]]]


def vocabulary(path: str) -> Vocabulary:
    if path not in _state:
        _state[path] = Vocabulary(path)
    return _state[path]


def words(texts: list[str], voc: Vocabulary) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words of the texts, the number of each word in order, and how many words each text has."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    s = "".join(texts)
    cp = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int32)
    if not len(cp):
        return [], np.zeros(0, np.int32), np.zeros(len(texts), np.int32)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), lens)
    start = pretoken_starts(cp, doc)
    start[1:] |= ~voc.joined(cp)
    a = np.flatnonzero(start)
    size = np.diff(np.append(a, len(cp)))
    single = size == 1
    code = np.empty(len(a), np.int64)
    chars, code1 = np.unique(cp[a[single]], return_inverse=True)
    code[single] = code1
    b, e = a[~single], (a + size)[~single]
    multi = [s[x:y] for x, y in zip(b.tolist(), e.tolist())]
    code2, uniq = pd.factorize(np.array(multi, dtype=object)) if multi else (np.zeros(0, int), [])
    code[~single] = code2 + len(chars)
    return [*map(chr, chars.tolist()), *uniq], code.astype(np.int32), np.bincount(doc[a], minlength=len(texts)).astype(np.int32)


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``key`` and ids (list of integers, without special tokens) of every row.

    Null and empty texts have the empty list; repeated rows come out as often as they come in; rows with a null key
    are kept; other columns are ignored.  The file at ``path`` must exist on every executor.
    """
    from fumikura.sources.stage import stage

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        voc, ctx, no = vocabulary(path), TaskContext.get(), 0
        held_k, held_t, size = [], [], 0

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal no
            block = ctx.partitionId() * (1 << 32) + no
            no += 1
            w, code, n = words(held_t, voc)
            yield _rows(block, [-1], [None], [np.array([-1 if k is None else 0 for k in held_k], np.int8).tobytes()], [np.array([k or 0 for k in held_k], "<i8").tobytes()], [n.astype("<i4").tobytes()], [code.astype("<u2" if len(w) < 65536 else "<u4").tobytes()])
            for a in range(0, len(w), 20_000):
                p = w[a : a + 20_000]
                none = [None] * len(p)
                yield _rows(block, list(range(a, a + len(p))), p, none, none, none, none)
            held_k.clear()
            held_t.clear()

        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held_k.append(k)
                held_t.append(t or "")
                size += len(t or "")
                if size >= block_chars or len(held_k) >= 100_000:
                    yield from out()
                    size = 0
        if held_k:
            yield from out()

    schema = "block long, no int, word string, nulls binary, keys binary, n binary, code binary"
    parts = stage(docs.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t")).mapInArrow(cut, schema), "words")

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = vocabulary(path).encode
        for b in batches:
            data = [np.array(enc(w.encode("utf-8", "surrogatepass")), "<i4").tobytes() for w in b.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("word"), pa.array(data, pa.binary())], names=["word", "code"])

    # a word that every block has is reduced to one row on the map side; its ids go back by a join AQE can split
    at = parts.where("no >= 0").select("block", "no", "word")
    coded = at.join(at.select("word").distinct().mapInArrow(once, "word string, code binary"), "word")
    null = F.lit(None).cast("binary")
    back = parts.where("no < 0").drop("word").unionByName(coded.select("block", "no", null.alias("nulls"), null.alias("keys"), null.alias("n"), "code"))

    def place(t: pa.Table) -> pa.Table:
        block = t.column("block").to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else []
        keys, lists = [], []
        code, nos = t.column("code"), t.column("no").to_numpy()
        for a, b in zip(starts, np.append(starts[1:], len(block))):
            # the first row holds the texts' words, the others the ids of each word
            seq_bytes = code[a].as_py()
            data = code.slice(a + 1, b - a - 1).combine_chunks()
            if isinstance(data, pa.ChunkedArray):
                data = data.chunk(0) if data.num_chunks else pa.array([], pa.binary())
            off = np.frombuffer(data.buffers()[1], "<i4", len(data) + 1, data.offset * 4) // 4 if len(data) else np.zeros(1, np.int32)
            assert (nos[a + 1 : b] == np.arange(b - a - 1)).all(), "words of a block are lost"
            flat = np.frombuffer(data.buffers()[2], "<i4")[off[0] : off[-1]] if len(data) and data.buffers()[2] is not None else np.zeros(0, np.int32)
            off = off - off[0]
            per = np.diff(off)
            seq = np.frombuffer(seq_bytes, "<u2" if b - a - 1 < 65536 else "<u4").astype(np.int64)
            n = np.frombuffer(t.column("n")[a].as_py(), "<i4")
            ks = np.frombuffer(t.column("keys")[a].as_py(), "<i8")
            nulls = np.frombuffer(t.column("nulls")[a].as_py(), np.int8) < 0
            count = per[seq]
            ends = np.cumsum(count)
            total = int(ends[-1]) if len(ends) else 0
            src = np.arange(total) - np.repeat(ends - count, count) + np.repeat(off[seq], count)
            ids = flat[src]
            bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n)])]
            keys.append(pa.array(ks, pa.int64(), mask=nulls))
            lists.append(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32), pa.int32())))
        if not keys:
            return pa.table({"k": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int32()))})
        return pa.table({"k": pa.chunked_array(keys), "ids": pa.chunked_array(lists)})

    return by_group(back, ["block"], ["no"], place, "k long, ids array<int>", min_rows=1).withColumnRenamed("k", key)


def _rows(block, no, word, nulls, keys, n, code) -> pa.RecordBatch:
    b = pa.binary()
    return pa.RecordBatch.from_arrays([pa.array([block] * len(no), pa.int64()), pa.array(no, pa.int32()), pa.array(word, pa.string()), pa.array(nulls, b), pa.array(keys, b), pa.array(n, b), pa.array(code, b)], names=["block", "no", "word", "nulls", "keys", "n", "code"])


def token_bytes(spark, path: str = VOCABULARY) -> DataFrame:
    """The token-byte table: id, bytes (its size is the vocabulary's)."""
    r = ranks(path)
    return spark.createDataFrame([(i, t) for t, i in r.items()], "id int, bytes binary")


def decode(ids: DataFrame, key: str = "doc_id", path: str = VOCABULARY) -> DataFrame:
    """Texts of lists of ids, through a join with the token-byte table; an empty list gives the empty text, a null
    list null, an id outside the vocabulary null."""
    table = F.broadcast(token_bytes(ids.sparkSession, path))  # bounded by the vocabulary: 50,256 rows
    t = ids.select(key, "ids", F.monotonically_increasing_id().alias("row"))
    e = t.select("row", F.posexplode("ids").alias("pos", "id")).join(table, "id", "left")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.hex("bytes").alias("h")))), lambda x: x["h"]), "")
    g = e.groupBy("row").agg(joined.alias("h"), F.max(F.col("bytes").isNull()).alias("bad"))
    j = t.join(g, "row", "left")
    return j.select(key, F.when(F.col("ids").isNull() | F.col("bad"), None).otherwise(F.decode(F.unhex(F.coalesce("h", F.lit(""))), "UTF-8")).alias("text"))
