"""Sentences and scans against plain versions: random lines cut into tiny blocks, and the whole of a test table."""

import os
import random

import numpy as np
import pytest

from fumikura.llm import scan, sentences
from fumikura.llm.sentences import ABBREV, BRACKETS, CLOSE, COMMA, DIGITS, EOS, LOWER, MARK, NUM_ABBREV, OPEN, PARTICLE, POINT, QUOTES, WORD


def plain_ends(c):
    """Positions that end a sentence in one line of token classes, token by token."""
    n, out = len(c), set()
    pairs, stack = [], []
    for j, x in enumerate(c):
        if x >= CLOSE:
            mine = [d for d in range(len(stack)) if c[stack[d]] - OPEN == x - CLOSE]
            if mine:
                pairs.append((stack[mine[-1]], j))
                del stack[mine[-1] :]
        elif x >= OPEN:
            stack.append(j)
    k = 0
    while k < n:
        a = k
        while k < n and c[k] in (POINT, MARK):
            k += 1
        if k == a:
            k += 1
            continue
        points = MARK not in c[a:k]
        nxt = c[k] if k < n else EOS
        prev = c[a - 1] if a else 0
        if points and (k - a > 1 or prev == ABBREV or prev == NUM_ABBREV and nxt == DIGITS or prev == DIGITS and nxt in (DIGITS, LOWER, WORD, ABBREV, NUM_ABBREV)):
            continue
        e = k
        while e < n and c[e] >= CLOSE:
            e += 1
        x = c[e] if e < n else EOS
        if x in (PARTICLE, COMMA, POINT, MARK) or x == LOWER and e > k and c[e - 1] - CLOSE < len(QUOTES):
            continue
        if not any(o < a and e - 1 < z for o, z in pairs):
            out.add(e - 1)
    return sorted(out | ({n - 1} if n else set()))


SYMBOLS = [0, 0, 0, POINT, MARK, COMMA, PARTICLE, DIGITS, ABBREV, NUM_ABBREV, LOWER, WORD, OPEN, OPEN + 1, CLOSE, CLOSE + 1, OPEN + len(QUOTES), CLOSE + len(QUOTES)]


@pytest.mark.parametrize("seed", range(150))
def test_blocks_compose(seed):
    """Lines over blocks of few tokens, composed step by step, give the ends of the lines as a whole."""
    r = random.Random(seed)
    lines = [[r.choice(SYMBOLS) for _ in range(r.randrange(14))] for _ in range(r.randrange(1, 5))]
    flat, want = [], []
    for j, ln in enumerate(lines):
        want += [len(flat) + e for e in plain_ends(ln)]
        flat += ln
        if j < len(lines) - 1 or r.random() < 0.5:
            flat.append(EOS)
    size = r.randrange(1, 6)
    blocks = [np.array(flat[p : p + size], np.uint8) for p in range(0, len(flat), size)]
    if not blocks:
        return
    maps = sentences.block_maps(blocks)
    fore, back = [], []
    for b, m in zip(blocks, maps):
        eos = np.flatnonzero(b == EOS)
        word = lambda z: sentences.reduced(z[z >= OPEN].tobytes())
        fore.append(m + bytes([len(eos) > 0]) + word(b[eos[-1] + 1 :] if len(eos) else b))
        back.append(bytes([b[0], len(eos) > 0]) + word(b[: eos[0]] if len(eos) else b))
    acc, entered = sentences._ENTER, []
    for f in fore:
        entered.append(acc)
        acc = sentences.forward(acc, f)
    acc, follows = sentences._END, [None] * len(blocks)
    for j in range(len(blocks) - 1, -1, -1):
        follows[j] = acc
        acc = sentences.backward(back[j], acc)
    said = sentences.says(blocks, [e[0] for e in entered], [f[0] for f in follows])
    got = []
    for j, (b, x) in enumerate(zip(blocks, said)):
        d = sentences.depth(b, sentences._opens(entered[j][sentences.STATES + 1 :]), b"" if b[-1] == EOS else follows[j][2:])
        got += [j * size + int(p) for p in np.flatnonzero((x == sentences.YES) | (x == sentences.OUTSIDE) & (d == 0))]
    assert got == want


def test_words_compose():
    """Reducing parts first changes nothing, whatever is open before."""
    r = random.Random(3)
    marks = [OPEN, OPEN + 1, CLOSE, CLOSE + 1, OPEN + len(QUOTES + BRACKETS) - 1]
    for _ in range(2000):
        a, b, s = (bytes(r.choice(marks) for _ in range(r.randrange(7))) for _ in range(3))
        s = bytes(x for x in s if x < CLOSE)
        assert sentences._opens(s + sentences.reduced(sentences.reduced(a) + sentences.reduced(b))) == sentences._opens(s + a + b)


@pytest.mark.parametrize(("radix", "backward"), [(2, False), (3, True), (256, False), (256, True)])
def test_scan(spark, radix, backward):
    r = random.Random(radix)
    rows = [(k, b, bytes([97 + r.randrange(26)])) for k in (5, -7) for b in r.sample(range(-3, 30), 17)] + [(9, 4, b"z")]
    got = scan.exclusive(spark.createDataFrame(rows, "k long, blk int, f binary"), ["k"], lambda a, b: a + b, b"", radix, backward).collect()
    want = {(k, b): b"".join(f for kk, bb, f in sorted(rows) if kk == k and (bb > b if backward else bb < b)) for k, b, _ in rows}
    assert {(x["k"], x["blk"]): bytes(x["before"]) for x in got} == want and len(got) == len(rows)
    assert scan.exclusive(spark.createDataFrame([], "k long, blk int, f binary"), ["k"], lambda a, b: a + b, b"").count() == 0


@pytest.mark.parametrize("block", [97, 16384])
def test_whole_table(spark, block):
    """Every volume of sf0.01, line by line."""
    d = "/root/testdata/sf0.01/tsv.parquet"
    if not os.path.exists(d):
        pytest.skip("no test data")
    t = spark.read.parquet(d)
    rows = t.where("work_stem is not null and vol_no is not null and line_no is not null and (i is not null or pos1 = 'EOS')").select("work_stem", "vol_no", "line_no", "i", sentences.token_class().alias("c")).distinct().toPandas()
    want = set()
    for (w, v), g in rows.sort_values("line_no").groupby(["work_stem", "vol_no"]):
        line, pos = [], []
        for i, c in [*zip(g["i"], g["c"]), (None, EOS)]:
            if c == EOS:
                want |= {(w, v, int(pos[e])) for e in plain_ends(line)}
                line, pos = [], []
            else:
                line.append(int(c))
                pos.append(i)
    got = [tuple(x) for x in sentences.sentence_ends(t, block).collect()]
    assert len(got) == len(set(got)) and set(got) == want
