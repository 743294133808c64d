"""PII spans: candidate generation and gradient-boosted trees.  DataFrame functions only.

Base spans (email, ip, card, phone) are regular expressions with value checks.  For the added
spans (the same kinds in other forms, and secrets), high-recall generators propose overlapping
candidates of each kind, from every start and with shorter readings of each; each candidate gets
format features (length, digits, separators, groups, check digit ...) and context features
(cue and decoy words before it, neighbouring characters); boosted trees, compiled to one SQL
expression, give a score, a logistic link fitted on held-out candidates calibrates it, and
candidates at or above their kind's threshold (the least that keeps ``PRECISION`` on held-out
candidates) become spans unless they overlap a base span of their kind or a candidate of their
kind with a higher score (then the longer, then the first).

The trees are fitted in numpy on the driver from generated examples (seeded, ``EXAMPLES`` of
them); no corpus rows reach the driver.  Offsets count code points, ends are exclusive.

Positions come from the gaps between matches: ``split`` by the pattern and ``regexp_extract_all``
see the same leftmost matches.  Patterns are possessive and anchored to the start of a run or
to the last match, which keeps the matches and avoids quadratic backtracking.

Defined results: null and empty texts have no spans; repeated rows are reported each; an empty
table yields no rows; columns of any name are kept (see ``free_name`` for those added).
"""

from __future__ import annotations

from functools import cache, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patternloom.llm._common import free_name, table

#: Kinds of base spans, and all kinds in their order.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
#: Base patterns.  ``\G|`` lets a match begin where the last one ended, inside a run.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_NEEDED = {"email": "@", "ip": ".", "phone": "+"}
#: Generators of candidates besides the base spans: the longest reading from each start.
GENERATORS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+\x20?(?:@|\[at\]|\(at\)|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\.|\[dot\]|\(dot\)|\x20dot\x20)\x20?[A-Za-z0-9-]{2,24}+){1,4}+",
    "ip": r"(?<![0-9A-Fa-f:.])(?:(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}+)?+::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}+)?+|(?:[0-9A-Fa-f]{1,4}:){2,7}+[0-9A-Fa-f]{1,4})(?![0-9A-Fa-f]|:[0-9A-Fa-f:]|\.[0-9])",
    "card": r"(?<![0-9])[0-9]{4}[\x20./_-]{1,2}[0-9]{4,6}[\x20./_-]{1,2}[0-9]{4,5}(?:[\x20./_-]{1,2}[0-9]{1,4})?(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:00[0-9]{1,3}[\x20.-]?)?\(?[0-9]{2,4}\)?[\x20./-]{1,2}[0-9]{3,4}[\x20./-]?[0-9]{3,4}(?![0-9A-Za-z])",
    "secret": r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{16,512}+={0,2}+|(?<=[:=\"']|[:=]\x20)(?<=(?i:passw|password|passwd|pwd|secret|token|key)[\"']?\x20?[:=]\x20?[\"']?)[^\s\"',;:=]{6,128}+",
}
#: Shorter readings of a candidate from the same start, as patterns of its value.
SHORTER = {
    "email": tuple(rf"^.+?(?:@|\[at\]|\(at\)|\x20at\x20)\x20?[A-Za-z0-9-]{{1,63}}+(?:\x20?(?:\.|\[dot\]|\(dot\)|\x20dot\x20)\x20?[A-Za-z0-9-]{{2,24}}+){{{n}}}" for n in (1, 2, 3)),
    "ip": (),
    "card": (r"^[0-9]{4}[\x20./_-]{1,2}[0-9]{4,6}[\x20./_-]{1,2}[0-9]{4,5}(?![0-9])",),
    "phone": (r"^\(?[0-9]{2,4}\)?[\x20./-]{1,2}[0-9]{3,4}[\x20./-]?[0-9]{3,4}(?![0-9A-Za-z])",),
    "secret": (),
}
CUES = {
    "email": ("mail", "contact", "write", "reach"),
    "ip": ("ip", "host", "server", "addr"),
    "card": ("card", "visa", "credit", "iban", "account"),
    "phone": ("phone", "tel", "call", "fax", "mobile"),
    "secret": ("token", "secret", "passw", "pwd", "api", "auth", "bearer", "key", "credential"),
}
#: Words that announce a lookalike.
DECOYS = {
    "email": ("dine", "lunch", "open"),
    "ip": ("time", "std", "clock"),
    "card": ("isbn", "order", "tracking", "part", "no"),
    "phone": ("isbn", "page", "item", "order", "room"),
    "secret": ("commit", "sha", "md5", "etag", "checksum", "rev", "file", "class", "see"),
}
FEATURES = ("length", "digits", "letters", "separators", "spaces", "groups", "brackets", "cue", "luhn", "before", "after", "words", "decoy", "capitals", "hex", "assigned", "changes", "domain", "dashes")
_DOMAIN = r"(?i:\b(?:com|org|net|edu|gov|info|io|co|uk|de|fr|es|it|nl|eu|example))$"
_CHANGE = "(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])"
EXAMPLES = 4_000
TREES, DEPTH, RATE, PRECISION = 24, 3, 0.3, 0.98
_CONTEXT = 24


# ------------------------------------------------------------------ columns


def _let(x: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


_NONE = "array<int>"


def _running(steps: Column) -> Column:
    """Running sums of an array of numbers, in blocks, so that appending stays cheap in long texts."""
    block = 256

    def sums(b: Column, shifted: bool) -> Column:
        start = F.struct(F.lit(0).alias("s"), F.array().cast(_NONE).alias("out"))
        step = lambda a, x: F.struct((a["s"] + x).alias("s"), F.concat(a["out"], F.array(a["s"] if shifted else a["s"] + x)).alias("out"))
        return F.aggregate(b, start, step, lambda a: a["out"])

    def blocks(x: Column) -> Column:
        count = F.ceil(F.size(x) / block).cast("int")
        return F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda k: sums(F.slice(x, k * block + 1, F.lit(block)), False))).otherwise(F.array().cast("array<array<int>>"))

    def joined(parts: Column) -> Column:
        base = sums(F.transform(parts, lambda w: F.element_at(w, -1)), True)
        return F.flatten(F.zip_with(parts, base, lambda w, b: F.transform(w, lambda y: y + b)))

    return _let(steps, lambda x: _let(blocks(x), joined))


def _found(text: Column, pattern: str, group: int) -> Column:
    """The matches of a pattern and the texts between them, as a struct (v, g)."""
    return F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("v"), F.split(text, pattern, -1).alias("g"))


def _spans_from(starts: Column, values: Column) -> Column:
    return F.zip_with(starts, values, lambda s, v: F.struct(s.alias("start"), (s + F.length(v)).alias("stop"), v.alias("value")))


def _matches(text: Column, pattern: str) -> Column:
    """Array of (start, stop, value) of the leftmost non-overlapping matches."""

    def placed(x: Column) -> Column:
        n = F.size(x["v"])
        gaps = F.transform(F.slice(x["g"], 1, n), F.length)
        before = F.concat(F.array(F.lit(0)), F.transform(F.slice(x["v"], 1, F.greatest(n - 1, F.lit(0))), F.length))
        steps = F.when(n > 0, F.zip_with(gaps, before, lambda a, b: a + b)).otherwise(F.array().cast(_NONE))
        return _spans_from(_running(steps), x["v"])

    return _let(_found(text, pattern, 0), placed)


def _candidates(text: Column, kind: str) -> Column:
    """Array of (start, stop, value) of overlapping candidates: every start, and shorter readings."""
    ahead = f"(?=({GENERATORS[kind]}))"

    def placed(x: Column) -> Column:
        gaps = F.transform(F.slice(x["g"], 1, F.size(x["v"])), F.length)
        return _spans_from(F.transform(_running(gaps), lambda s: s - 1), x["v"])

    # empty matches cut the text at the starts; the line break keeps the first piece from being left out
    longest = _let(_found(F.concat(F.lit("\n"), text), ahead, 1), placed)
    if not SHORTER[kind]:
        return longest

    def readings(m):
        values = F.array_distinct(F.array(m["value"], *[F.regexp_extract(m["value"], p, 0) for p in SHORTER[kind]]))
        return F.transform(F.filter(values, lambda v: v != ""), lambda v: F.struct(m["start"].alias("start"), (m["start"] + F.length(v)).alias("stop"), v.alias("value")))

    return F.flatten(F.transform(longest, readings))


def luhn(value: Column) -> Column:
    """Whether the digits of a text pass the Luhn check."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, v: Column) -> Column:
    n = F.length(F.regexp_replace(v, "[^0-9]", ""))
    if kind == "ip":
        part = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{0,2})"
        return v.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.when(n.between(12, 19), luhn(v)).otherwise(F.lit(False))
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def features(kind: str, v: Column, before: Column, after: Column) -> list[Column]:
    """Format and context features of one candidate, in the order of FEATURES."""
    count = lambda chars: F.length(v) - F.length(F.regexp_replace(v, chars, ""))
    digits = count("[0-9]")
    cue = F.lower(before).rlike(r"\b(?:" + "|".join(CUES[kind]) + ")")
    return [
        F.length(v), digits, count("[A-Za-z]"), count("[-./_:@]"), count(" "), F.size(F.split(v, "[^0-9A-Za-z]+")), count(r"[()\[\]]"), cue.cast("int"),
        F.when(digits.between(12, 19), luhn(v)).otherwise(F.lit(False)).cast("int"), F.substring(before, -1, 1).rlike("[0-9A-Za-z.,/-]").cast("int"), F.substring(after, 1, 1).rlike("[0-9A-Za-z/_-]").cast("int"),
        F.size(F.split(v, r"\b(?:at|dot)\b")) - 1, F.lower(before).rlike(r"\b(?:" + "|".join(DECOYS[kind]) + r")\b").cast("int"), count("[A-Z]"),
        v.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$").cast("int"), before.rlike("[=:]\\x20?[\"']?$").cast("int"), F.size(F.split(v, _CHANGE)) - 1, v.rlike(_DOMAIN).cast("int"), count("-"),
    ]


# ------------------------------------------------------------------ model


def _luhn_digit(digits: list[int]) -> int:
    total = sum(d if i % 2 else (d * 2 - 9 if d > 4 else d * 2) for i, d in enumerate(reversed(digits)))
    return -total % 10


def _secret(r: np.random.Generator, yes: int, before: str, after: str) -> tuple[str, str, str]:
    """A generated secret, or a lookalike, and its surroundings."""
    pick = lambda xs: xs[int(r.integers(len(xs)))]
    of = lambda chars, k: "".join(chars[int(i)] for i in r.integers(0, len(chars), k))
    low, digit = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    hexes, mixed = digit + low[:6], digit + low + low.upper()
    name = lambda: of(low, int(r.integers(3, 9)))
    if yes:
        kind = r.random()
        if kind < 0.75:
            v = pick([of(hexes, pick([32, 40, 64])), of(mixed, int(r.integers(20, 48))), pick(["sk_live_", "sk-", "ghp_", "AKIA"]) + of(mixed, int(r.integers(16, 36)))])
            cue = pick(["token", "api_key", "secret", "auth token", "access key", "credentials"])
        else:
            v, cue = of(mixed + "!#$%", int(r.integers(8, 16))), pick(["password", "passwd", "pwd", "secret"])
        mark = pick([' = "', "=", ": ", ':"', " = '"])
        return v, before + cue + mark, mark[-1] if mark[-1] in "\"'" else pick([" ", "\n", ""])
    kind = r.random()
    if kind < 0.3:  # names of files, classes and links with a number
        v = pick(["_", "-", "/"]).join([name() for _ in range(int(r.integers(3, 6)))] + [of(digit, int(r.integers(1, 5)))])
        before += pick(["see ", "file ", "", "class "])
    elif kind < 0.55:  # hashes that name content
        v, before = of(hexes, pick([32, 40, 64])), before + pick(["commit ", "sha ", "md5: ", "etag: ", "checksum ", "rev ", 'sha = "'])
    elif kind < 0.75:  # long numbers with a letter, and words run together
        v = pick([of(digit, 18) + pick(list(low)), name() + name() + name() + of(digit, 1)])
    else:  # plain words after a cue
        v, before = pick([name() + "_" + name(), "none" + name(), name() + "()", name() + "." + name()]), before + pick(["token: ", "key = ", "secret: ", "password: "])
    return v, before, after


def examples(kind: str, n: int, seed: int = 5) -> list[tuple[str, str, str, int]]:
    """Generated candidates (value, before, after, label): true forms of the kind and lookalikes."""
    r = np.random.Generator(np.random.PCG64([seed, KINDS.index(kind)]))
    pick = lambda xs: xs[int(r.integers(len(xs)))]
    num = lambda k: "".join(map(str, r.integers(0, 10, k)))
    word = lambda: "".join(pick(["an", "er", "th", "ou", "le", "sch", "ci", "ment", "re", "on"]) for _ in range(int(r.integers(1, 4))))
    out = []
    for _ in range(n):
        yes = int(r.random() < 0.5)
        before = f"{word()} {word()} "
        after = pick([" ", ".", ",", "\n", ""]) + word()[:1]
        if kind == "email":
            if yes:
                at, dot = pick([("[at]", "[dot]"), ("(at)", "(dot)"), (" at ", " dot "), (" [at] ", " [dot] "), (" @ ", ".")])
                v = f"{word()}{pick(['.', '_', ''])}{pick([num(2), ''])}{at}{word()}{dot}{pick(['com', 'org', 'net', 'example', 'de', 'fr', 'es', 'co', 'edu'])}"
                before += pick(["mail ", "contact ", "", ""])
            else:
                v = f"{word()} at {word()}.{word().capitalize()}" if r.random() < 0.7 else f"{word()} at {word()} dot {word()}s{word()}"
                if r.random() < 0.3:  # a sentence that ends, and one that begins with a short word
                    v = f"{word()} at {word()}. {pick(['Es', 'De', 'It', 'Fr', 'Co', 'In', 'No', word().capitalize()])}"
                v = v if r.random() < 0.6 else f"{word()} at {num(2)}.{num(2)}"
        elif kind == "ip":
            if yes:
                v = ":".join(f"{int(r.integers(4096, 65536)):x}" for _ in range(pick([7, 8, 8, 8])))
                if r.random() < 0.5:  # compressed: up to four groups before '::' and one to four after it
                    part = lambda k: ":".join(f"{int(r.integers(1, 65536)) >> pick([0, 0, 4, 12]):x}" for _ in range(k))
                    v = f"{pick(['', 'fe80', '2001:db8', '2a02:' + part(1), 'fd00:' + part(2), part(4)])}::{pick([str(int(r.integers(1, 10))), part(1), part(2), part(3), part(4)])}"
                before += pick(["ip ", "host ", "", ""])
            else:
                v = ":".join(num(2) for _ in range(3)) if r.random() < 0.6 else ":".join(f"{int(r.integers(0, 60)):02d}" for _ in range(4))
                if r.random() < 0.3:  # names joined by '::', whole or as part of a longer name
                    v = f"{pick(['', 'a', 'bad', 'face', 'd', 'ace'])}::{pick(['a', 'bad', 'add', 'c', 'feed', 'be'])}"
                    before, after = pick([(before, after), (before + word(), after), (before, word())])
        elif kind == "card":
            groups = pick([(4, 4, 4, 4), (4, 6, 5)])
            digits = [int(c) for c in num(sum(groups) - 1)]
            chance = not yes and r.random() < 0.3  # a lookalike that passes the check by chance
            digits.append(_luhn_digit(digits) if yes or chance else (_luhn_digit(digits) + int(r.integers(1, 10))) % 10)
            sep = pick([".", "/", "_", "  ", "-", " - "[:2]]) if yes else pick([".", "/", "-", " ", "_"])
            text, at = "".join(map(str, digits)), 0
            parts = []
            for g in groups:
                parts.append(text[at : at + g])
                at += g
            v = sep.join(parts)
            if chance:  # part of a longer number, or announced as another one
                before += pick([num(4) + sep, "order ", "isbn ", "tracking ", f"part {num(4)}{sep}", f"order {num(4)}{sep}"])
            else:
                before += pick(["card ", "visa ", "", ""]) if yes else pick(["no ", "order ", "", ""])
        elif kind == "secret":
            v, before, after = _secret(r, yes, before, after)
        else:
            if yes:
                v = pick([f"({num(3)}) 555-{num(4)}", f"{num(3)}-555-{num(4)}", f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}"])
                bare = v[0] == "(" or "-" in v  # written as a phone: it needs no cue word
                before += pick(["tel ", "phone ", "call ", "mobile ", *(["", "us ", "office ", "the "] if bare else [])])
            else:
                v = pick([f"{num(4)}-{num(4)}", f"{num(4)} {num(3)} {num(3)}", f"{num(3)}/{num(3)}{num(4)}", f"{num(2)}.{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}"])
                phone_like = v.count("-") == 2
                before += pick(["page ", "item ", "isbn ", "order ", "room "] if phone_like else ["", "", "page ", "item "])
                after = pick([after, "/", "-"])
        out.append((v, before, after, yes))
    return out


def _numpy_features(kind: str, rows: list[tuple[str, str, str, int]]) -> np.ndarray:
    import re

    def one(v: str, before: str, after: str) -> list[float]:
        count = lambda chars: len(re.findall(chars, v))
        digits = [int(c) for c in v if c.isdigit()]
        ok = 12 <= len(digits) <= 19 and _luhn_digit(digits[:-1]) == digits[-1]
        cue = re.search(r"\b(?:" + "|".join(CUES[kind]) + ")", before.lower())
        return [len(v), len(digits), count("[A-Za-z]"), count("[-./_:@]"), count(" "), len(re.split("[^0-9A-Za-z]+", v)), count(r"[()\[\]]"), bool(cue), ok, bool(re.match("[0-9A-Za-z.,/-]", before[-1:])), bool(re.match("[0-9A-Za-z/_-]", after[:1])), len(re.split(r"\b(?:at|dot)\b", v)) - 1,
                bool(re.search(r"\b(?:" + "|".join(DECOYS[kind]) + r")\b", before.lower())), count("[A-Z]"), bool(re.fullmatch("[0-9a-f]+|[0-9A-F]+", v)), bool(re.search("[=:]\\x20?[\"']?$", before)), len(re.split(_CHANGE, v)) - 1, bool(re.search(_DOMAIN, v)), count("-")]

    return np.asarray([one(*r[:3]) for r in rows], float)


def _tree(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
    """A regression tree on gradients: (feature, cut, low, high) or a leaf value."""
    leaf = float(-g.sum() / (h.sum() + 1.0))
    if depth == 0 or len(g) < 20:
        return leaf
    best = (1e-6, None, None)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, gs, hs = x[order, f], np.cumsum(g[order]), np.cumsum(h[order])
        for k in np.flatnonzero(v[1:] != v[:-1]):
            gain = gs[k] ** 2 / (hs[k] + 1) + (gs[-1] - gs[k]) ** 2 / (hs[-1] - hs[k] + 1) - gs[-1] ** 2 / (hs[-1] + 1)
            if gain > best[0]:
                best = (gain, f, (v[k] + v[k + 1]) / 2)
    if best[1] is None:
        return leaf
    low = x[:, best[1]] <= best[2]
    return (best[1], float(best[2]), _tree(x[low], g[low], h[low], depth - 1), _tree(x[~low], g[~low], h[~low], depth - 1))


def _apply(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, cut, low, high = tree
    return np.where(x[:, f] <= cut, _apply(low, x), _apply(high, x))


@cache
def fit(kind: str) -> tuple[tuple, float, float, float]:
    """Boosted trees of one kind, and from held-out examples the calibration (slope, shift) and
    the least threshold of the precision asked for."""
    rows = examples(kind, EXAMPLES)
    x, y = _numpy_features(kind, rows), np.asarray([r[3] for r in rows], float)
    train = np.arange(len(y)) % 4 != 0
    z, trees = np.zeros(len(y)), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        tree = _tree(x[train], (p - y)[train], (p * (1 - p))[train], DEPTH)
        trees.append(tree)
        z += RATE * _apply(tree, x)
    a, b = 1.0, 0.0
    for _ in range(200):  # logistic calibration on the other quarter
        p = 1 / (1 + np.exp(-(a * z[~train] + b)))
        e = p - y[~train]
        a, b = a - 0.05 * float((e * z[~train]).mean()), b - 0.05 * float(e.mean())
    p = 1 / (1 + np.exp(-(a * z[~train] + b)))
    cuts = [c for c in np.linspace(0.5, 0.99, 50).tolist() if y[~train][p >= c].mean() >= PRECISION] if (p >= 0.99).any() else []
    return tuple(trees), a, b, min(cuts, default=0.9)


def score(kind: str, x: Column) -> Column:
    """Calibrated probability of a candidate whose features are the array ``x``."""
    trees, a, b, _ = fit(kind)

    def compiled(tree) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(tree * RATE)
        f, cut, low, high = tree
        return F.when(x[f] <= cut, compiled(low)).otherwise(compiled(high))

    z = reduce(Column.__add__, [compiled(t) for t in trees])
    return 1 / (1 + F.exp(-(z * a + b)))


# ------------------------------------------------------------------ operator


def find_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``base_spans`` and ``added_spans``: arrays of (start, rank, kind, stop)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    digit = whole.rlike("[0-9]")
    out, base, more = docs, [], []
    for rank, kind in enumerate(KINDS):
        b, c = free_name(docs, f"_b{rank}"), free_name(docs, f"_c{rank}")
        if kind in BASE:
            there = F.contains(whole, F.lit(_NEEDED[kind])) if kind in _NEEDED else digit
            there = there & digit if kind in ("ip", "phone") else there
            out = out.withColumn(b, F.transform(_kept(F.when(there, _matches(whole, BASE[kind])), kind), _spanned(rank, kind)))
            base.append(b)
        out = out.withColumn(c, F.when(_possible(kind, whole, digit), _candidates(whole, kind)))
        out = out.withColumn(c, _described(kind, whole, c))
        out = out.withColumn(c, _accepted(rank, kind, c, b if kind in BASE else None))
        more.append(c)
    all_of = lambda names: F.array_sort(F.concat(*[F.coalesce(n, F.array().cast(_SPANS)) for n in names]))
    named = [all_of(x).alias(free_name(docs, n)) for x, n in ((base, "base_spans"), (more, "added_spans"))]
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], *named)


_SPANS = "array<struct<start:int,rank:int,kind:string,stop:int>>"
_ITEMS = "array<struct<start:int,stop:int,loss:double>>"


def _kept(matches: Column, kind: str) -> Column:
    return F.filter(matches, lambda m: _valid(kind, m["value"]))


def _spanned(rank: int, kind: str):
    return lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), m["stop"].alias("stop"))


def _possible(kind: str, whole: Column, digit: Column) -> Column:
    if kind == "email":
        return whole.rlike(r"@|\[at\]|\(at\)|\x20at\x20[^\n]{1,80}(?:\.|dot)")
    if kind == "secret":
        return whole.rlike("(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{16}|(?i:passw|pwd|secret|token|key)[a-z]{0,4}[\"']?\\x20?[:=]")
    return whole.rlike(":[0-9A-Fa-f]{0,4}:") if kind == "ip" else digit


#: Characters of a piece in which contexts are looked up.
_PIECE = 1024


def _described(kind: str, whole: Column, candidates: str) -> Column:
    """Candidates as (start, stop, x): places and features.

    Contexts are read from pieces of the text, so a candidate far into a long text costs no more than one
    at its beginning.
    """

    def described(pieces):
        piece = lambda k: F.coalesce(F.get(pieces, k.cast("int")), F.lit(""))

        def one(m):
            first = F.greatest(m["start"] - _CONTEXT, F.lit(0))
            k = F.floor(first / _PIECE)
            before = F.substring(F.concat(piece(k), piece(k + 1)), (first % _PIECE + 1).cast("int"), m["start"] - first)
            after = F.substring(piece(F.floor(m["stop"] / _PIECE)), (m["stop"] % _PIECE + 1).cast("int"), F.lit(1))
            seen = F.struct(m["value"].alias("v"), before.alias("before"), after.alias("after"))
            x = _let(seen, lambda c: F.array(*[f.cast("double") for f in features(kind, c["v"], c["before"], c["after"])]))
            return F.struct(m["start"].alias("start"), m["stop"].alias("stop"), x.alias("x"))

        return F.transform(candidates, one)

    return F.when(F.size(candidates) > 0, _let(F.regexp_extract_all(whole, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0)), described))


def _accepted(rank: int, kind: str, candidates: str, base: str | None) -> Column:
    """The candidates over the threshold that overlap no base span and no better candidate.

    Spans are swept in order of their start into groups that touch no other group; within a group the best
    come first, base spans before all.
    """
    item = lambda loss, start, stop: F.struct(start.alias("start"), stop.alias("stop"), loss.alias("loss"))
    # equal features have one score
    kinds = F.array_distinct(F.transform(candidates, lambda m: m["x"]))
    losses = _let(kinds, lambda k: F.struct(k.alias("k"), F.transform(k, lambda x: -score(kind, x)).alias("loss")))
    scored = _let(losses, lambda t: F.transform(candidates, lambda m: item(F.element_at(t["loss"], F.array_position(t["k"], m["x"]).cast("int")), m["start"], m["stop"])))
    spans = F.filter(scored, lambda m: m["loss"] <= -fit(kind)[3])
    if base:
        held = F.transform(F.coalesce(F.col(base), F.array().cast(_SPANS)), lambda m: item(F.lit(-2.0), m["start"], m["stop"]))
        spans = F.concat(held, spans)
    empty = F.array().cast(_ITEMS)
    start = F.struct(F.lit(0).alias("stop"), empty.alias("own"), F.array().cast(f"array<{_ITEMS}>").alias("done"))

    def sweep(a, m):
        joins = m["start"] < a["stop"]
        own = F.when(joins, F.concat(a["own"], F.array(m))).otherwise(F.array(m))
        return F.struct(F.when(joins, F.greatest(a["stop"], m["stop"])).otherwise(m["stop"]).alias("stop"), own.alias("own"), F.when(joins, a["done"]).otherwise(F.concat(a["done"], F.array(a["own"]))).alias("done"))

    groups = F.aggregate(F.array_sort(spans), start, sweep, lambda a: F.concat(a["done"], F.array(a["own"])))
    apart = lambda kept, m: ~F.exists(kept, lambda b: (b["start"] < m["stop"]) & (m["start"] < b["stop"]))
    step = lambda kept, m: F.when(apart(kept, m), F.concat(kept, F.array(item(m["loss"], m["start"], m["stop"])))).otherwise(kept)
    order = lambda g: F.array_sort(F.transform(g, lambda m: F.struct(m["loss"].alias("loss"), (m["start"] - m["stop"]).alias("short"), m["start"].alias("start"), m["stop"].alias("stop"))))
    best = lambda g: F.when(F.size(g) < 2, g).otherwise(F.aggregate(order(g), empty, step))
    kept = F.filter(F.flatten(F.transform(groups, best)), lambda m: m["loss"] > -1.5)
    return F.when(F.size(candidates) > 0, F.transform(kept, _spanned(rank, kind)))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text", mark: str = "[{}]") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind's mark; overlapping spans leave one mark."""
    names = [free_name(docs, n) for n in ("base_spans", "added_spans")]
    spans = F.array_sort(F.concat(*names))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda a, s: F.when(s["start"] < a["at"], a).otherwise(F.struct(s["stop"].alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.format_string(mark.replace("{}", "%s"), s["kind"])).alias("out")))
    new = F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return find_spans(docs, text).withColumn(text, F.when(F.size(spans) > 0, new).otherwise(F.col(text))).drop(*names)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of ``documents``."""
    found = find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    whole = F.concat("base_spans", "added_spans")
    return found.select(
        "doc_id", *map(n, BASE_KINDS), F.sha2(_written(F.col("base_spans")), 256).alias("base_sha256"), _written(F.array_sort(whole)).alias("spans"),
        F.size("added_spans").cast("long").alias("n_added"), F.size(F.filter("added_spans", lambda s: s["kind"] == "secret")).cast("long").alias("n_secret"), F.size(whole).cast("long").alias("n_spans"),
    )
