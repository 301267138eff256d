"""Problem 5: sentence boundaries across languages and scripts.

Method: the boundary rules are compiled into a finite transducer over a small alphabet of token classes (``compiled``
enumerates its states from the rules of ``step``); it reads a token and says whether the one before ends a sentence:
surely, or if it isn't inside brackets that close on the line.  Brackets nest without bound, so beside the state a
block has a bracket word: what it does to the stack of open brackets (closing marks it couldn't pair itself and marks
it left open).

A volume is cut into blocks of file lines.  Each block is read on its own into a state-transition function (a state
for each state, and the word) and the word of its first line; these are composed by a parallel prefix scan, forward
for the state a block is entered in, backward for what follows on its last line.  Then each block writes its ends.  No
task ever holds more than a block and the unpaired brackets of the line around it, also where a volume has no EOS.
Token strings never leave the JVM: the class of a token depends on its own surface and part of speech.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fumikura.llm.scan import exclusive
from fumikura.plans.blocks import by_bytes, by_group, key_starts, map_arrow
from fumikura.sources.corpus import VKEYS, volume_keys
from fumikura.sources.stage import stage

BLOCK = 16_384
# classes of tokens
OTHER, EOS, POINT, MARK, COMMA, PARTICLE, DIGITS, ABBREV, NUM_ABBREV, LOWER, WORD, OPEN, CLOSE = 0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 20, 60
#: Closing marks, commas, brackets and quotation marks by pairs (quotation marks first).
POINTS, MARKS, COMMAS = (".", "．"), ("。", "！", "？", "!", "?", "।", "॥", "｡"), ("、", "，", ",", "､")
QUOTES = ("「」", "『』", "“”", "«»", "‘’", "„‟", "‹›", "〝〟", "｢｣")
BRACKETS = ("（）", "()", "［］", "[]", "〈〉", "《》", "【】", "〔〕", "｛｝", "{}")
PAIRS = QUOTES + BRACKETS
#: Abbreviations that take a point and never end a sentence; those that do so only before a number.
ABBREVIATIONS = ("Prof", "Dr", "Mr", "Mrs", "Ms", "St", "Mme", "Mlle", "MM", "Mgr", "Hr", "Fr", "Frl", "Jr", "Sr", "Rev", "Hon", "Gen", "Col", "Capt", "Lt", "Sgt", "Cf", "cf", "vs", "viz", "bzw", "ca", "usw", "vgl", "Vgl", "гг", "им", "ул", "стр", "проф", "др", "см", "тов", "i.e", "e.g", "z.B", "d.h", "u.a", "U.S", "a.m", "p.m")
NUMBERED = ("No", "no", "Nr", "Nos", "vol", "Vol", "vols", "p", "pp", "ch", "Ch", "chap", "Bd", "Abb", "Kap", "fig", "Fig", "art", "Art", "sec", "Sec", "S", "т", "гл")


def token_class() -> Column:
    """Class of a row from ``i``, ``surface`` and ``pos1``; a null surface is an ordinary token."""
    s = F.col("surface")
    c = F.when(F.col("i").isNull(), EOS).when(F.col("pos1") == "助詞", PARTICLE).when(s.isin(*MARKS), MARK).when(s.isin(*POINTS), POINT).when(s.isin(*COMMAS), COMMA)
    for j, (a, b) in enumerate(PAIRS):
        c = c.when(s == a, OPEN + j).when(s == b, CLOSE + j)
    c = c.when(s.rlike(r"^[\p{IsHiragana}\p{IsKatakana}\p{IsHan}]"), OTHER)  # most tokens: decided early
    c = c.when(s.rlike(r"^\p{Nd}+$"), DIGITS).when(s.isin(*NUMBERED) & ~s.rlike(r"^.$"), NUM_ABBREV).when(s.isin(*ABBREVIATIONS) | s.rlike(r"^[\p{IsLatin}\p{IsCyrillic}\p{IsGreek}]$"), ABBREV)
    return c.when(s.rlike(r"^[\p{IsLatin}\p{IsCyrillic}\p{IsGreek}]"), F.when(s.rlike(r"^\p{Ll}"), LOWER).otherwise(WORD)).otherwise(OTHER).cast("tinyint")


# what the transducer reads: classes with brackets by kind
_CLOSE_QUOTE, _CLOSE_BRACKET, _NOTHING = 11, 12, 13
_SYMBOL = np.zeros(128, np.uint8)
_SYMBOL[: WORD + 1] = np.arange(WORD + 1)
_SYMBOL[CLOSE : CLOSE + len(QUOTES)] = _CLOSE_QUOTE
_SYMBOL[CLOSE + len(QUOTES) : CLOSE + len(PAIRS)] = _CLOSE_BRACKET
#: What is said of the token before: it ends no sentence, it does, it does if no pair of brackets is around it.
NO, YES, OUTSIDE = 0, 1, 2
START = ("start",)


def step(state: tuple, x: int) -> tuple[tuple, int]:
    """The state after a token of class x, and what is said of the token before it.

    States: the line's start; after a token (of a kind that matters to a point); after a single point; after several
    points and nothing else; after a run with a closing mark; after closing brackets or quotation marks behind one.
    """
    if x == EOS:
        return START, NO if state == START else YES
    kind = state[0]
    closing = x in (_CLOSE_QUOTE, _CLOSE_BRACKET)
    run = x in (POINT, MARK)
    if kind in ("point", "points", "mark") and run:
        return (("mark",) if x == MARK or kind == "mark" else ("points",)), NO
    said, candidate = NO, kind in ("mark", "closed")
    if kind == "point":
        before = state[1]
        number = before == DIGITS and x in (DIGITS, LOWER, WORD, ABBREV, NUM_ABBREV)
        candidate = not (before == ABBREV or before == NUM_ABBREV and x == DIGITS or number)
    if candidate:
        if closing:
            return ("closed", x), NO
        goes_on = x in (PARTICLE, COMMA) or run or x == LOWER and state == ("closed", _CLOSE_QUOTE)
        said = NO if goes_on else OUTSIDE
    if x == MARK:
        return ("mark",), said
    if x == POINT:
        return ("point", state[1] if kind == "token" else OTHER), said
    return ("token", x if x in (ABBREV, NUM_ABBREV, DIGITS) else OTHER), said


def compiled() -> tuple[np.ndarray, np.ndarray]:
    """Tables class x state: the next state and what is said; state 0 is the start.  All states the rules reach."""
    states, todo, rows = {START: 0}, [START], []
    while todo:
        s = todo.pop(0)
        row = []
        for x in range(_NOTHING):
            t, said = step(s, x)
            if t not in states:
                states[t] = len(states)
                todo.append(t)
            row.append((states[t], said))
        rows.append((states[s], row))
    n = len(states)
    to, out = np.zeros((_NOTHING + 1, n), np.uint8), np.zeros((_NOTHING + 1, n), np.uint8)
    for s, row in rows:
        for x, (t, said) in enumerate(row):
            to[x, s], out[x, s] = t, said
    to[_NOTHING] = np.arange(n)
    return to, out


TO, SAYS = compiled()
STATES = TO.shape[1]
_WIDTH = 64


def _rows(blocks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of blocks in rows of a fixed width, each block filled up, and the first row of each."""
    n = np.array([-(-len(b) // _WIDTH) for b in blocks], np.int64)
    first = np.concatenate([[0], np.cumsum(n)])
    out = np.full(int(first[-1]) * _WIDTH, _NOTHING, np.uint8)
    for b, at in zip(blocks, first.tolist()):
        out[at * _WIDTH : at * _WIDTH + len(b)] = _SYMBOL[b]
    return out.reshape(-1, _WIDTH), first


def _row_maps(sym: np.ndarray) -> np.ndarray:
    """The state each row leads to from each state."""
    m = np.broadcast_to(np.arange(STATES, dtype=np.uint8), (len(sym), STATES))
    for k in range(_WIDTH):
        m = TO[sym[:, k, None], m]
    return m


def block_maps(blocks: list[np.ndarray]) -> list[bytes]:
    """State-transition functions of blocks of classes."""
    sym, first = _rows(blocks)
    rows, out = _row_maps(sym), []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        m = np.arange(STATES, dtype=np.uint8)
        for r in range(a, b):
            m = rows[r][m]
        out.append(m.tobytes())
    return out


def says(blocks: list[np.ndarray], entered: list[int], following: list[int]) -> list[np.ndarray]:
    """What is said of each token of blocks that are entered in the given states and followed by the given classes."""
    sym, first = _rows([np.append(b, x).astype(np.uint8) for b, x in zip(blocks, following)])
    maps, state = _row_maps(sym), np.zeros(len(sym), np.uint8)
    for s, a, b in zip(entered, first[:-1].tolist(), first[1:].tolist()):
        for r in range(a, b):
            state[r] = s
            s = int(maps[r, s])
    out = np.zeros(sym.shape, np.uint8)
    for k in range(_WIDTH):
        out[:, k] = SAYS[sym[:, k], state]
        state = TO[sym[:, k], state]
    flat = out.ravel()
    return [flat[a * _WIDTH + 1 : a * _WIDTH + 1 + len(b)] for b, a in zip(blocks, first.tolist())]


def reduced(word: bytes) -> bytes:
    """A bracket word without the pairs it holds.  A closing mark takes the nearest open one of its kind and all open
    ones after it; past a closing mark that may still find its partner before the word nothing is decided."""
    left: list[int] = []
    for x in word:
        if x >= CLOSE:
            k = len(left) - 1
            while k >= 0 and left[k] < CLOSE and left[k] - OPEN != x - CLOSE:
                k -= 1
            if k >= 0 and left[k] < CLOSE:
                del left[k:]
                continue
        left.append(x)
    return bytes(left)


def _opens(word: bytes) -> bytes:
    """What a word leaves open at the start of a line: closing marks without a partner do nothing."""
    left: list[int] = []
    for x in word:
        if x < CLOSE:
            left.append(x)
        else:
            for k in range(len(left) - 1, -1, -1):
                if left[k] - OPEN == x - CLOSE:
                    del left[k:]
                    break
    return bytes(left)


def depth(c: np.ndarray, before: bytes, after: bytes) -> np.ndarray:
    """For each token how many pairs of brackets that close on its line are around it or end behind it; ``before`` is
    left open when the block begins, ``after`` follows on its last line."""
    d = np.zeros(len(c) + 1, np.int32)
    stack = [(x - OPEN, 0) for x in before]
    at = np.flatnonzero((c >= OPEN) | (c == EOS)).tolist()
    for p, x in [*zip(at, c[at].tolist()), *((len(c), x) for x in after)]:
        if x == EOS:
            stack.clear()
        elif x < CLOSE:
            stack.append((x - OPEN, p))
        else:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == x - CLOSE:
                    d[stack[k][1]] += 1
                    d[p] -= 1
                    del stack[k:]
                    break
    return np.cumsum(d[:-1])


def forward(first: bytes, then: bytes) -> bytes:
    """Composition of (states, whether a line ended, word since then)."""
    m = np.frombuffer(then, np.uint8, STATES)[np.frombuffer(first, np.uint8, STATES)]
    if then[STATES]:
        return m.tobytes() + then[STATES:]
    return m.tobytes() + first[STATES : STATES + 1] + reduced(first[STATES + 1 :] + then[STATES + 1 :])


def backward(first: bytes, then: bytes) -> bytes:
    """Composition of (first class, whether the first line ended, its word)."""
    if first[1]:
        return first
    return first[:1] + then[1:2] + reduced(first[2:] + then[2:])


_ENTER = np.arange(STATES, dtype=np.uint8).tobytes() + b"\0"
_END = bytes([EOS, 1])


def sentence_ends(tsv: DataFrame, block: int = BLOCK) -> DataFrame:
    """work_stem, vol_no, i of the last token of every sentence.

    Rows without keys and broken rows are left out, repeated rows count once, a volume without EOS ends where its
    tokens end, an empty table gives no row.
    """
    t = tsv.where("work_stem is not null and vol_no is not null and line_no is not null and (i is not null or pos1 = 'EOS')")
    t = t.select(*volume_keys(), "work_stem", "vol_no", F.floor(F.col("line_no") / block).cast("int").alias("blk"), "line_no", F.coalesce("i", F.lit(0)).alias("i"), token_class().alias("cls"))

    def read(x: pa.Table) -> pa.Table:
        line, i, cls = x.column("line_no").to_numpy(), x.column("i").to_numpy(), x.column("cls").to_numpy()
        starts = key_starts(x, [*VKEYS, "blk"])
        new = np.ones(len(line), bool)
        new[1:] = line[1:] != line[:-1]
        new[starts] = True
        blocks, pos, fore, back = [], [], [], []
        for a, b in zip(starts, np.append(starts[1:], len(line))):
            keep = new[a:b]
            c = cls[a:b][keep].astype(np.uint8)
            blocks.append(c)
            pos.append(i[a:b][keep].astype("<i4").tobytes())
            eos = np.flatnonzero(c == EOS)
            word = lambda z: reduced(z[z >= OPEN].tobytes())
            fore.append(bytes([len(eos) > 0]) + word(c[eos[-1] + 1 :] if len(eos) else c))
            back.append(bytes([c[0], len(eos) > 0]) + word(c[: eos[0]] if len(eos) else c))
        head = x.select([*VKEYS, "work_stem", "vol_no", "blk"]).take(pa.array(starts))
        for name, v in (("cls", [c.tobytes() for c in blocks]), ("i", pos), ("fore", [m + w for m, w in zip(block_maps(blocks), fore)]), ("back", back)):
            head = head.append_column(name, pa.array(v, pa.binary()))
        return head

    schema = "vkey long, vkey2 long, work_stem string, vol_no int, blk int, cls binary, i binary, fore binary, back binary"
    parts = stage(by_group(t, [*VKEYS, "blk"], ["line_no"], read, schema), "sentences")
    several = parts.groupBy(*VKEYS).agg(F.count("*").alias("k")).where("k > 1").drop("k")
    chain = stage(parts.join(several, VKEYS, "left_semi").select(*VKEYS, "blk", "fore", "back"), "chains")
    at = [*VKEYS, "blk"]
    entered = exclusive(chain.select(*at, F.col("fore").alias("f")), VKEYS, forward, _ENTER).withColumnRenamed("before", "entered")
    follows = exclusive(chain.select(*at, F.col("back").alias("f")), VKEYS, backward, _END, backward=True).withColumnRenamed("before", "follows")

    def ends_of(x: pa.Table) -> pa.Table:
        blocks = [np.frombuffer(c, np.uint8) for c in x.column("cls").to_pylist()]
        entered = [e or _ENTER for e in x.column("entered").to_pylist()]
        follows = [f or _END for f in x.column("follows").to_pylist()]
        src, ends = [], []
        for r, (c, said) in enumerate(zip(blocks, says(blocks, [e[0] for e in entered], [f[0] for f in follows]))):
            end = said == YES
            maybe = said == OUTSIDE
            if maybe.any():
                after = b"" if c[-1] == EOS else follows[r][2:]
                end |= maybe & (depth(c, _opens(entered[r][STATES + 1 :]), after) == 0)
            e = np.frombuffer(x.column("i")[r].as_py(), "<i4")[end]
            src.append(np.full(len(e), r))
            ends.append(e)
        out = x.select(["work_stem", "vol_no"]).take(pa.array(np.concatenate(src), pa.int64()))
        return out.append_column("i", pa.array(np.concatenate(ends), pa.int32()))

    def write(x: pa.Table) -> pa.Table:
        return pa.concat_tables([ends_of(p) for p in by_bytes(x, "cls", 2_000_000)])

    j = parts.join(entered.join(follows, at), at, "left").select("work_stem", "vol_no", "cls", "i", "entered", "follows")
    return map_arrow(j, write, "work_stem string, vol_no int, i int", min_rows=50)


def found(tsv: DataFrame) -> DataFrame:
    e = sentence_ends(tsv)
    return e.select("work_stem", F.col("vol_no").cast("bigint").alias("vol_no"), F.col("i").cast("bigint").alias("i"))
