"""Phonetic encodings that expressions can't give: Daitch-Mokotoff, Double Metaphone and Beider-Morse.

They run as Arrow functions over a vocabulary of distinct tokens. The rules of Daitch-Mokotoff and of
Beider-Morse (generic names, approximate, any language) are data of the Apache codec
library that is part of each Spark installation; the driver's JVM reads them from its class path.
Double Metaphone follows Lawrence Philips' published algorithm (C/C++ Users Journal, June 2000).
"""

from __future__ import annotations

import re
from functools import cache, lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .encoding import encodable

MOST_PHONEMES = 20
LONGEST_METAPHONE = 6


_texts: dict[str, str] = {}
_NEEDED = ("dmrules", "bm/gen_rules_any", "bm/gen_approx_common", "bm/gen_exact_approx_common", "bm/gen_approx_any")


def rule_texts() -> dict[str, str]:
    """The rule files, by the class loader of the driver's JVM, wherever Spark lives; workers get them with the function that needs them."""
    if not _texts:
        jvm = SparkSession.getActiveSession().sparkContext._jvm
        loader = jvm.org.apache.spark.util.Utils.getContextOrSparkClassLoader()
        for name in _NEEDED:
            stream = loader.getResourceAsStream(f"org/apache/commons/codec/language/{name}.txt")
            _texts[name] = bytes(stream.readAllBytes()).decode()
            stream.close()
    return _texts


def use_texts(texts: dict[str, str]) -> None:
    _texts.update(texts)


@cache
def _resource(name: str) -> list[str]:
    text = rule_texts()[name]
    lines = re.sub(r"/\*.*?\*/", "", text, flags=re.S).splitlines()
    return [x for x in (line.split("//")[0].strip() for line in lines) if x]


# ---- Daitch-Mokotoff


@cache
def _dm_rules() -> tuple[dict[str, list[tuple]], dict[str, str]]:
    rules, folds = {}, {}
    for line in _resource("dmrules"):
        if line.startswith('"'):
            pattern, *codes = re.findall(r'"([^"]*)"', line)
            rules.setdefault(pattern[0], []).append((pattern, *[c.split("|") for c in codes]))
        else:
            a, b = line.split("=")
            folds[a.strip()] = b.strip()
    for own in rules.values():
        own.sort(key=lambda r: -len(r[0]))
    return rules, folds


@lru_cache(100_000)
def daitch_mokotoff(word: str) -> tuple[str, ...]:
    """All codes of six digits."""
    rules, folds = _dm_rules()
    text = "".join(folds.get(c, c) for c in word.lower() if not c.isspace())
    branches, last, i = [("", None)], "", 0
    while i < len(text):
        c = text[i]
        rule = next((r for r in rules.get(c, ()) if text.startswith(r[0], i)), None)
        if c in rules:
            if rule:
                after = text[i + len(rule[0]) : i + len(rule[0]) + 1]
                codes = rule[1] if not last else rule[2] if after and after in "aeiou" else rule[3]
                force = {last, c} == {"m", "n"}
                new = {}
                for digits, before in branches:
                    for code in codes:
                        add = before is None or not before.endswith(code) or force
                        new.setdefault(((digits + code)[:6] if add else digits, code))
                first: dict[str, tuple] = {}
                for d, b in new:
                    first.setdefault(d, (d, b))
                branches = list(first.values())
                i += len(rule[0]) - 1
            last = c
        i += 1
    return tuple(dict.fromkeys(d.ljust(6, "0") for d, _ in branches))


# ---- Beider-Morse


def _phonemes(text: str) -> list[tuple[str, frozenset | None]]:
    """(text, languages) of a rule's right side; None stands for any language."""

    def one(part: str) -> tuple[str, frozenset | None]:
        head, _, langs = part.partition("[")
        return head, frozenset(langs.rstrip("]").split("+")) if langs else None

    if not text.startswith("("):
        return [one(text)]
    body = text[1:-1]
    parts = body.split("|")
    while parts and not parts[-1]:
        parts.pop()
    out = [one(p) for p in parts]
    return out + [("", None)] if body.startswith("|") or body.endswith("|") else out


def _context(rule: str) -> str:
    """A context without a character class is literal text between its anchors, dots included."""
    if "[" in rule:
        return rule
    start, end = rule.startswith("^"), rule.endswith("$")
    return "^" * start + re.escape(rule.removeprefix("^").removesuffix("$")) + "$" * end


@cache
def _bm_rules(name: str) -> dict[str, list[tuple]]:
    rules: dict[str, list[tuple]] = {}

    def read(n: str) -> None:
        for line in _resource(f"bm/{n}"):
            if line.startswith("#include"):
                read(line.split()[1])
            else:
                pattern, left, right, out = re.findall(r'"([^"]*)"', line)
                rules.setdefault(pattern[0], []).append((pattern, re.compile(_context(left) + "$") if left else None, re.compile("^" + _context(right)) if right else None, _phonemes(out)))

    read(name)
    return rules


def _both(a: frozenset | None, b: frozenset | None) -> frozenset | None:
    return b if a is None else a if b is None else a & b


def _apply(rules: dict, text: str, phonemes: list, keep: bool) -> list:
    """phonemes extended by text's rules; characters without a rule are kept or left out."""
    i = 0
    while i < len(text):
        for pattern, left, right, out in rules.get(text[i], ()):
            end = i + len(pattern)
            if text.startswith(pattern, i) and (not right or right.search(text[end:])) and (not left or left.search(text[:i])):
                new = []
                for a, la in phonemes:
                    for b, lb in out:
                        langs = _both(la, lb)
                        if langs is None or langs:
                            new.append((a + b, langs))
                        if len(new) >= MOST_PHONEMES:
                            break
                    if len(new) >= MOST_PHONEMES:
                        break
                phonemes, i = new, end
                break
        else:
            if keep:
                phonemes = [(a + text[i], langs) for a, langs in phonemes]
            i += 1
    return phonemes


@lru_cache(100_000)
def beider_morse(word: str) -> tuple[str, ...]:
    """The sorted alternatives of a single word."""
    phonemes = _apply(_bm_rules("gen_rules_any"), word.lower(), [("", None)], keep=False)
    for name in ("gen_approx_common", "gen_approx_any"):
        found: dict[str, frozenset | None] = {}
        for text, langs in phonemes:
            for new, own in _apply(_bm_rules(name), text, [("", langs)], keep=True):
                found[new] = own if new not in found or found[new] is None else None if own is None else found[new] | own
        phonemes = sorted(found.items())
    return tuple(t for t, _ in phonemes if t)


# ---- Double Metaphone


def _has(w: str, i: int, *options: str) -> bool:
    return i >= 0 and w.startswith(options, i)


def _is_vowel(w: str, i: int) -> bool:
    return 0 <= i < len(w) and w[i] in "AEIOUY"


@lru_cache(100_000)
def double_metaphone(word: str) -> tuple[str, str]:
    """Primary and alternate code, LONGEST_METAPHONE characters at most."""
    w = word.strip().upper()
    if not w:
        return "", ""
    slavic = any(x in w for x in ("W", "K", "CZ", "WITZ"))
    n, last = len(w), len(w) - 1
    one, two = [], []
    germanic = w.startswith(("VAN ", "VON ", "SCH"))
    i = 1 if w.startswith(("GN", "KN", "PN", "WR", "PS")) else 0

    def add(a: str, b: str | None = None) -> None:
        one.append(a)
        two.append(a if b is None else b)

    while i < n and (len("".join(one)) < LONGEST_METAPHONE or len("".join(two)) < LONGEST_METAPHONE):
        c = w[i]
        double = 2 if _has(w, i + 1, c) else 1
        if c in "AEIOUY":
            if i == 0:
                add("A")
            i += 1
        elif c == "B":
            add("P")
            i += double
        elif c == "Ç":
            add("S")
            i += 1
        elif c == "C":
            i = _c(w, i, last, add)
        elif c == "D":
            if _has(w, i, "DG"):
                if _has(w, i + 2, "I", "E", "Y"):
                    add("J")
                    i += 3
                else:
                    add("TK")
                    i += 2
            else:
                add("T")
                i += 2 if _has(w, i, "DT", "DD") else 1
        elif c == "F":
            add("F")
            i += double
        elif c == "G":
            i = _g(w, i, slavic, add)
        elif c == "H":
            if (i == 0 or _is_vowel(w, i - 1)) and _is_vowel(w, i + 1):
                add("H")
                i += 2
            else:
                i += 1
        elif c == "J":
            i = _j(w, i, last, slavic, add)
        elif c == "K":
            add("K")
            i += double
        elif c == "L":
            if double == 2:
                ends = (i == n - 3 and _has(w, i - 1, "ILLO", "ILLA", "ALLE")) or ((w[n - 2 :] in ("AS", "OS") or w[n - 1] in "AO") and _has(w, i - 1, "ALLE"))
                add("L", "" if ends else None)
            else:
                add("L")
            i += double
        elif c == "M":
            add("M")
            i += 2 if double == 2 or (_has(w, i - 1, "UMB") and (i + 1 == last or _has(w, i + 2, "ER"))) else 1
        elif c == "N":
            add("N")
            i += double
        elif c == "Ñ":
            add("N")
            i += 1
        elif c == "P":
            if _has(w, i + 1, "H"):
                add("F")
                i += 2
            else:
                add("P")
                i += 2 if _has(w, i + 1, "P", "B") else 1
        elif c == "Q":
            add("K")
            i += double
        elif c == "R":
            silent = i == last and not slavic and _has(w, i - 2, "IE") and not _has(w, i - 4, "ME", "MA")
            add("" if silent else "R", "R")
            i += double
        elif c == "S":
            i = _s(w, i, last, germanic, slavic, add)
        elif c == "T":
            if _has(w, i, "TION", "TIA", "TCH"):
                add("X")
                i += 3
            elif _has(w, i, "TH", "TTH"):
                if _has(w, i + 2, "OM", "AM") or germanic:
                    add("T")
                else:
                    add("0", "T")
                i += 2
            else:
                add("T")
                i += 2 if _has(w, i + 1, "T", "D") else 1
        elif c == "V":
            add("F")
            i += double
        elif c == "W":
            if _has(w, i, "WR"):
                add("R")
                i += 2
            elif i == 0 and (_is_vowel(w, 1) or _has(w, 0, "WH")):
                add("A", "F" if _is_vowel(w, 1) else "A")
                i += 1
            elif (i == last and _is_vowel(w, i - 1)) or _has(w, i - 1, "EWSKI", "EWSKY", "OWSKI", "OWSKY") or w.startswith("SCH"):
                add("", "F")
                i += 1
            elif _has(w, i, "WICZ", "WITZ"):
                add("TS", "FX")
                i += 4
            else:
                i += 1
        elif c == "X":
            if i == 0:
                add("S")
                i += 1
            else:
                if not (i == last and (_has(w, i - 3, "IAU", "EAU") or _has(w, i - 2, "AU", "OU"))):
                    add("KS")
                i += 2 if _has(w, i + 1, "C", "X") else 1
        elif c == "Z":
            if _has(w, i + 1, "H"):
                add("J")
                i += 2
            else:
                if _has(w, i + 1, "ZO", "ZI", "ZA") or (slavic and i > 0 and w[i - 1] != "T"):
                    add("S", "TS")
                else:
                    add("S")
                i += double
        else:
            i += 1
    return "".join(one)[:LONGEST_METAPHONE], "".join(two)[:LONGEST_METAPHONE]


def _c(w, i, last, add) -> int:
    chia = _has(w, i, "CHIA")
    germanic = i > 1 and not _is_vowel(w, i - 2) and _has(w, i - 1, "ACH") and ((not _has(w, i + 2, "I", "E")) or _has(w, i - 2, "BACHER", "MACHER"))
    if chia or germanic:
        add("K")
        return i + 2
    if i == 0 and _has(w, i, "CAESAR"):
        add("S")
        return i + 2
    if _has(w, i, "CH"):
        if i > 0 and _has(w, i, "CHAE"):
            add("K", "X")
        elif i == 0 and (_has(w, 1, "HARAC", "HARIS") or _has(w, 1, "HOR", "HYM", "HIA", "HEM")) and not _has(w, 0, "CHORE"):
            add("K")
        elif w.startswith(("VAN ", "VON ", "SCH")) or _has(w, i - 2, "ORCHES", "ARCHIT", "ORCHID") or _has(w, i + 2, "T", "S") or ((_has(w, i - 1, "A", "O", "U", "E") or i == 0) and (_has(w, i + 2, "L", "R", "N", "M", "B", "H", "F", "V", "W", " ") or i + 1 == last)):
            add("K")
        elif i > 0:
            if w.startswith("MC"):
                add("K")
            else:
                add("X", "K")
        else:
            add("X")
        return i + 2
    if _has(w, i, "CZ") and not _has(w, i - 2, "WICZ"):
        add("S", "X")
        return i + 2
    if _has(w, i + 1, "CIA"):
        add("X")
        return i + 3
    if _has(w, i, "CC") and not (i == 1 and w[0] == "M"):
        if _has(w, i + 2, "I", "E", "H") and not _has(w, i + 2, "HU"):
            if (i == 1 and w[0] == "A") or _has(w, i - 1, "UCCEE", "UCCES"):
                add("KS")
            else:
                add("X")
            return i + 3
        add("K")
        return i + 2
    if _has(w, i, "CK", "CG", "CQ"):
        add("K")
        return i + 2
    if _has(w, i, "CI", "CE", "CY"):
        if _has(w, i, "CIO", "CIE", "CIA"):
            add("S", "X")
        else:
            add("S")
        return i + 2
    add("K")
    if _has(w, i + 1, " C", " Q", " G"):
        return i + 3
    return i + 2 if _has(w, i + 1, "C", "K", "Q") and not _has(w, i + 1, "CE", "CI") else i + 1


def _g(w, i, slavic, add) -> int:
    if _has(w, i + 1, "H"):
        if i > 0 and not _is_vowel(w, i - 1):
            add("K")
        elif i == 0:
            add("J" if _has(w, i + 2, "I") else "K")
        elif (i > 1 and _has(w, i - 2, "B", "H", "D")) or (i > 2 and _has(w, i - 3, "B", "H", "D")) or (i > 3 and _has(w, i - 4, "B", "H")):
            pass
        elif i > 2 and w[i - 1] == "U" and _has(w, i - 3, "C", "G", "L", "R", "T"):
            add("F")
        elif i > 0 and w[i - 1] != "I":
            add("K")
        return i + 2
    if _has(w, i + 1, "N"):
        if i == 1 and _is_vowel(w, 0) and not slavic:
            add("KN", "N")
        elif not _has(w, i + 2, "EY") and not _has(w, i + 1, "Y") and not slavic:
            add("N", "KN")
        else:
            add("KN")
        return i + 2
    if _has(w, i + 1, "LI") and not slavic:
        add("KL", "L")
        return i + 2
    if i == 0 and (_has(w, 1, "Y") or _has(w, 1, "ES", "EP", "EB", "EL", "EY", "IB", "IL", "IN", "IE", "EI", "ER")):
        add("K", "J")
        return i + 2
    if _has(w, i + 1, "ER", "Y") and not _has(w, 0, "DANGER", "RANGER", "MANGER") and not _has(w, i - 1, "E", "I") and not _has(w, i - 1, "RGY", "OGY"):
        add("K", "J")
        return i + 2
    if _has(w, i + 1, "E", "I", "Y") or _has(w, i - 1, "AGGI", "OGGI"):
        if w.startswith(("VAN ", "VON ", "SCH")) or _has(w, i + 1, "ET"):
            add("K")
        elif _has(w, i + 1, "IER"):
            add("J")
        else:
            add("J", "K")
        return i + 2
    add("K")
    return i + 2 if _has(w, i + 1, "G") else i + 1


def _j(w, i, last, slavic, add) -> int:
    if _has(w, i, "JOSE") or w.startswith("SAN "):
        if (i == 0 and (len(w) == 4 or _has(w, 4, " "))) or w.startswith("SAN "):
            add("H")
        else:
            add("J", "H")
        return i + 1
    if i == 0:
        add("J", "A")
    elif _is_vowel(w, i - 1) and not slavic and _has(w, i + 1, "A", "O"):
        add("J", "H")
    elif i == last:
        add("J", " ")
    elif not _has(w, i + 1, "L", "T", "K", "S", "N", "M", "B", "Z") and not _has(w, i - 1, "S", "K", "L"):
        add("J")
    return i + 2 if _has(w, i + 1, "J") else i + 1


def _s(w, i, last, germanic, slavic, add) -> int:
    if _has(w, i - 1, "ISL", "YSL"):
        return i + 1
    if i == 0 and _has(w, i, "SUGAR"):
        add("X", "S")
        return i + 1
    if _has(w, i, "SH"):
        add("S" if _has(w, i + 1, "HEIM", "HOEK", "HOLM", "HOLZ") else "X")
        return i + 2
    if _has(w, i, "SIO", "SIA", "SIAN"):
        if slavic:
            add("S")
        else:
            add("S", "X")
        return i + 3
    if (i == 0 and _has(w, 1, "M", "N", "L", "W")) or _has(w, i + 1, "Z"):
        add("S", "X")
        return i + 2 if _has(w, i + 1, "Z") else i + 1
    if _has(w, i, "SC"):
        if _has(w, i + 2, "H"):
            if _has(w, i + 3, "OO", "ER", "EN", "UY", "ED", "EM"):
                if _has(w, i + 3, "ER", "EN"):
                    add("X", "SK")
                else:
                    add("SK")
            elif i == 0 and not _is_vowel(w, 3) and not _has(w, 3, "W"):
                add("X", "S")
            else:
                add("X")
        elif _has(w, i + 2, "I", "E", "Y"):
            add("S")
        else:
            add("SK")
        return i + 3
    if i == last and _has(w, i - 2, "AI", "OI"):
        add("", "S")
    else:
        add("S")
    return i + 2 if _has(w, i + 1, "S", "Z") else i + 1


def metaphones(word: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(c for c in double_metaphone(word) if c))


ENCODERS = {"ds": daitch_mokotoff, "dm": metaphones, "bm": beider_morse}


def encode_vocabulary(tokens: DataFrame, kinds: tuple[str, ...] = ("ds", "dm", "bm")) -> DataFrame:
    """(token, kind, value) of the distinct tokens that have encodings; a code equal to the token, or one that can't be made, is left out."""

    texts = dict(rule_texts())

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("value", T.StringType())])))
    def codes(words: pd.Series) -> pd.Series:
        use_texts(texts)
        return words.map(lambda w: [{"kind": k, "value": v} for k in kinds for v in ENCODERS[k](w) if v and v != w])

    every = tokens.select("token").distinct().where(encodable(F.col("token")))
    return every.select("token", F.explode(codes("token")).alias("c")).select("token", "c.kind", "c.value")
