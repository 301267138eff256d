"""Letters of a text: letters and digits in one writing, as arrays of code points.

Glosses 《…》 and notes ［＃…］ are removed first; then width (compatibility forms), case and old or new forms of
kanji are made one.  Works over many texts at once.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np

_ANNOTATION = re.compile("《[^《》]*》|［＃[^［］]*］")
#: Old forms of common kanji and the new forms, in order.
OLD = "亞惡壓圍醫爲壹榮營衞驛圓緣應歐櫻奧橫溫假價畫會壞懷繪擴覺學樂卷歡觀關陷顏歸氣舊據擧曉區惠經繼輕藝擊縣劍檢權險顯驗嚴廣鑛號國黑濟雜參殘絲兒辭濕實舍寫壽收從處將燒稱證條淨疊讓觸寢眞盡圖醉數聲靜齊專戰淺錢雙壯爭總聰裝騷臟藏屬續體對帶臺擇澤單擔膽團斷遲晝蟲聽鐵轉點傳盜燈當德獨讀屆腦廢拜賣麥發髮祕佛變邊辯步寶豐沒每萬滿默譯藥與餘譽樣來賴亂龍兩綠淚勵禮靈齡戀爐勞樓囘晚錄靑敎歷淸飮"
NEW = "亜悪圧囲医為壱栄営衛駅円縁応欧桜奥横温仮価画会壊懐絵拡覚学楽巻歓観関陥顔帰気旧拠挙暁区恵経継軽芸撃県剣検権険顕験厳広鉱号国黒済雑参残糸児辞湿実舎写寿収従処将焼称証条浄畳譲触寝真尽図酔数声静斉専戦浅銭双壮争総聡装騒臓蔵属続体対帯台択沢単担胆団断遅昼虫聴鉄転点伝盗灯当徳独読届脳廃拝売麦発髪秘仏変辺弁歩宝豊没毎万満黙訳薬与余誉様来頼乱竜両緑涙励礼霊齢恋炉労楼回晩録青教歴清飲"
assert len(OLD) == len(NEW), (len(OLD), len(NEW))

_tables: dict[bool, tuple[np.ndarray, np.ndarray]] = {}
_runs: dict[bool, re.Pattern] = {}


def _fold(s: str) -> str:
    s = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", s).lower())
    return s.translate(_KANJI)


_KANJI = {ord(a): b for a, b in zip(OLD, NEW) if a != b}


def _table(digits: bool) -> tuple[np.ndarray, np.ndarray]:
    """By code point: the letter it stands for (0: none), and whether it must be folded with its neighbours."""
    if digits not in _tables:
        to, slow = np.zeros(0x110000, np.uint32), np.zeros(0x110000, bool)
        for c in range(0x110000):
            if 0xD800 <= c < 0xE000:
                continue
            ch = chr(c)
            cat = unicodedata.category(ch)
            if cat in ("Cn", "Co"):
                continue
            f = ch if 0x3400 <= c < 0xA000 and ch not in OLD or 0xAC00 <= c < 0xD7A4 or 0x20000 <= c < 0x2F800 else _fold(ch)
            if cat[0] == "M" or len(f) != 1 or c in (0xFF9E, 0xFF9F) or unicodedata.combining(ch) or cat == "Lo" and (0x1100 <= c < 0x1200):
                slow[c] = True
                # what is left of it after folding with its neighbours stands for itself
                if cat[0] in "LN":
                    to[c] = c
            elif unicodedata.category(f)[0] in "LN" and (digits or not "0" <= f <= "9"):
                to[c] = ord(f)
        _tables[digits] = to, slow
    return _tables[digits]


def _slow_runs(digits: bool) -> re.Pattern:
    """Runs that must be folded as a whole: marks and letters that compose, with the character before them."""
    if digits not in _runs:
        at = np.flatnonzero(_table(digits)[1])
        cut = np.flatnonzero(np.diff(at) > 1)
        ranges = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(at[np.r_[0, cut + 1]], at[np.r_[cut, len(at) - 1]]))
        _runs[digits] = re.compile(f"[^{ranges}]?[{ranges}]+")
    return _runs[digits]


def letters(texts: list[str | None], digits: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The letters of all texts one after the other, and how many each text has."""
    to, slow = _table(digits)
    clean = [_ANNOTATION.sub("", t) if t and ("《" in t or "［＃" in t) else t or "" for t in texts]
    cp = np.frombuffer("".join(clean).encode("utf-32-le", "surrogatepass"), "<u4")
    n = np.fromiter(map(len, clean), np.int64, len(clean))
    if slow[cp].any():
        doc = np.repeat(np.arange(len(clean)), n)
        for j in np.unique(doc[slow[cp]]).tolist():
            clean[j] = _slow_runs(digits).sub(lambda m: _fold(m[0]), clean[j])
        cp = np.frombuffer("".join(clean).encode("utf-32-le", "surrogatepass"), "<u4")
        n = np.fromiter(map(len, clean), np.int64, len(clean))
    x = to[cp]
    keep = x > 0
    ends = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], np.cumsum(n)])]
    return x[keep], np.diff(ends)


def rolling(x: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of each k consecutive values."""
    if len(x) < k:
        return np.zeros(0, np.uint64)
    m = len(x) - k + 1
    y = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    y ^= y >> np.uint64(29)
    y *= np.uint64(0xBF58476D1CE4E5B9)
    # doubling: hashes of 1, 2, 4, ... values are put together to k
    have, total, at, step = y, None, 0, 1
    while step <= k:
        if k & step:
            part = have[at : at + m]
            total = part.copy() if total is None else total * np.uint64(0xD6E8FEB86659FD93) + part
            at += step
        if step * 2 <= k:
            have = have[:-step] * np.uint64(pow(0x94D049BB133111EB, step, 1 << 64) | 1) + have[step:]
        step *= 2
    total ^= total >> np.uint64(32)
    total *= np.uint64(0x94D049BB133111EB)
    return total ^ (total >> np.uint64(29))
