"""Personal data by boosted trees over candidate spans; DataFrame functions alone touch the rows.

Four strict detectors give the base spans. Three generators with high recall propose spans
besides, overlapping ones too: runs of digits, long tokens, things around an at sign. Each
candidate has a few yes/no features of its format and context. Gradient-boosted trees are fitted
on counts by feature pattern (at most 2^13 rows, over all documents). Positives are what the
strict checks and assignments to a key word find, in forms that these themselves would miss: phone
numbers without the plus, cards and tokens without the words before them, addresses spelled with
"[at]". Negatives are the candidates as they stand that no check covers. Thresholds calibrated on
the documents that the trees have not seen choose the candidates to add. The trees run as column
expressions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import names_apart, table

KINDS = ("email", "ip", "card", "phone", "number", "token", "contact")

# The base patterns in the form that Java's matcher runs in linear time and without recursion: they find the same
# matches, as a look-behind only skips starts inside a run that fail whenever the run's start does.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

NUMBER = r"\+?[0-9](?:[\x20().-]{0,2}[0-9]){6,}+"
TOKEN = r"[A-Za-z0-9_-]{16,}+"
CONTACT = r"[^\s@(\[]{1,64}+\s?(?:@|[(\[]at[)\]])\s?[^\s@]{1,64}+"

CONTEXT_WORDS = r"(?i)(card|visa|account|phone|tel|call|fax|mail|contact|reach|ip|host|token|key|secret|password)[^\n]{0,12}$"
KEY_WORDS = r"(?i)(token|key|secret|password|passwd)\s*[=:]\s*[\"']?$"
FEATURES = 13
ROUNDS, RATE, DAMPING = 30, 0.3, 1.0
#: A kind's threshold is the least at which this share of the held-out candidates above it is positive, with one more of
#: either label counted in, so that a handful of candidates is not enough.
PRECISION = 0.9


def _matches(text: Column, pattern: str, needed: Column) -> Column:
    """The leftmost, non-overlapping matches: start, end, the match, up to 30 characters before and 1 after it."""
    empty = F.array().cast("array<struct<start:int,end:int,m:string,before:string,after:string>>")
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    state = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["piece"])
        end = start + F.char_length(x["m"])
        one = F.struct(start.alias("start"), end.alias("end"), x["m"].alias("m"), F.substr(x["piece"], F.greatest(F.lit(1), F.char_length(x["piece"]) - 29)).alias("before"), F.substr(x["next"], F.lit(1), F.lit(1)).alias("after"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    joined = F.transform(F.arrays_zip(pieces.alias("piece"), found.alias("m")), lambda x, i: F.struct(x["piece"].alias("piece"), x["m"].alias("m"), F.get(pieces, i + 1).alias("next")))
    return F.when(needed & (F.size(found) > 0), F.aggregate(F.filter(joined, lambda x: x["m"].isNotNull()), state, add, lambda acc: acc["out"])).otherwise(empty)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _part_ok(p: Column) -> Column:
    short = F.regexp_replace(p, "^0+", "")
    return F.when(F.length(short) <= 3, F.coalesce(short.try_cast("int"), F.lit(0)) <= 255).otherwise(False)


STRICT = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: F.forall(F.split(m, r"\."), _part_ok),
    "card": lambda m: F.length(_digits(m)).between(14, 19) & F.call_function("luhn_check", _digits(m)),
    "phone": lambda m: F.length(_digits(m)).between(10, 15),
}


def _bits(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.when(t, F.lit(1 << i)).otherwise(F.lit(0)) for i, t in enumerate(tests)])


def _mask(kind: int, m: Column, before: Column) -> Column:
    n = F.length(_digits(m))
    tests = [
        F.lit(KINDS[kind] == "number"),
        F.lit(KINDS[kind] == "token"),
        n >= 10,
        n >= 14,
        m.rlike("[A-Za-z]") & m.rlike("[0-9]"),
        ~m.rlike("[^0-9a-fA-F]"),
        F.length(m) >= 32,
        m.rlike(r"[\x20().-]"),
        m.rlike(r"\.[A-Za-z0-9-]+\.?[^A-Za-z0-9]?$"),
        m.rlike(r"^[+(]"),
        before.rlike(r"[=:\"'(]\s?$"),
        before.rlike(CONTEXT_WORDS),
        n == F.lit(16),
    ]
    return _bits(tests)


def _candidate(kind: int, x: Column, base: Column) -> Column:
    covered = F.exists(base, lambda b: (b["start"] < x["end"]) & (b["end"] > x["start"]))
    assigned = x["before"].rlike(KEY_WORDS) if KINDS[kind] == "token" else F.lit(False)
    return F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).alias("kind"), _mask(kind, x["m"], x["before"]).alias("mask"), assigned.alias("assigned"), covered.alias("covered"))


def _made(kind: str, m: Column, before: Column) -> list[Column]:
    """A find of ``kind`` in forms that the strict checks miss, as positive examples: kind and mask."""
    bare = F.lit("")
    forms = {
        "email": [("contact", F.regexp_replace(m, "@", " [at] "), w) for w in (before, bare)],
        "card": [("number", m, w) for w in (before, bare)],
        "phone": [("number", F.substr(m, F.lit(2)), w) for w in (before, bare)],
        "token": [("token", m, bare)],
    }
    return [F.struct(F.lit(KINDS.index(k)).alias("kind"), _mask(KINDS.index(k), f, w).alias("mask")) for k, f, w in forms[kind]]


def _base(i: int, kind: str, matches: Column) -> Column:
    kept = F.filter(matches, lambda x: STRICT[kind](x["m"]))
    return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(i).alias("kind")))


def _candidates(kind: int, matches: Column, base: Column) -> Column:
    return F.transform(matches, lambda x: _candidate(kind, x, base))


def _count(kind: int) -> Column:
    return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")


def with_candidates(docs: DataFrame, examples: bool = False) -> DataFrame:
    """``docs`` with _pii_base (start, end, kind), _pii_found (the candidates with mask, assigned, covered) and, if asked for,
    _pii_made (kind and mask of the positive examples)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    digit, at = text.rlike("[0-9]"), F.contains(text, F.lit("@"))
    needed = {"email": at, "ip": digit, "card": digit, "phone": digit & F.contains(text, F.lit("+"))}
    strict = {kind: _matches(text, pattern, needed[kind]) for kind, pattern in {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}.items()}
    base = [_base(i, kind, matches) for i, (kind, matches) in enumerate(strict.items())]
    with_base = docs.withColumn("_pii_base", F.concat(*base))
    more = [(4, NUMBER, digit, ""), (5, TOKEN, digit, "[0-9]"), (6, CONTACT, at | text.rlike(r"[(\[]at[)\]]"), "")]
    loose = {k: F.filter(_matches(text, pattern, need), lambda x: x["m"].rlike(has)) for k, pattern, need, has in more}
    out = with_base.withColumn("_pii_found", F.concat(*[_candidates(k, matches, F.col("_pii_base")) for k, matches in loose.items()]))
    if examples:
        kept = {kind: F.filter(strict[kind], lambda x: STRICT[kind](x["m"])) for kind in ("email", "card", "phone")}
        kept["token"] = F.filter(loose[KINDS.index("token")], lambda x: x["before"].rlike(KEY_WORDS))
        made = [F.flatten(F.transform(finds, lambda x: F.array(*_made(kind, x["m"], x["before"])))) for kind, finds in kept.items()]
        out = out.withColumn("_pii_made", F.concat(*made))
    return out


@dataclass
class Tree:
    """Two questions deep: a feature, the feature asked next on either side, and the four leaves (no-no, no-yes, yes-no, yes-yes)."""

    root: int
    no: int
    yes: int
    leaves: tuple[float, float, float, float]

    def column(self, mask: Column) -> Column:
        bit = lambda i: mask.bitwiseAND(F.lit(1 << i)) != 0
        a, b, c, d = self.leaves
        return F.when(bit(self.root), F.when(bit(self.yes), d).otherwise(c)).otherwise(F.when(bit(self.no), b).otherwise(a))

    def values(self, bits: np.ndarray) -> np.ndarray:
        a, b, c, d = self.leaves
        return np.where(bits[:, self.root], np.where(bits[:, self.yes], d, c), np.where(bits[:, self.no], b, a))


@dataclass
class PiiModel:
    prior: float = 0.0
    trees: list[Tree] = field(default_factory=list)
    thresholds: dict[int, float] = field(default_factory=dict)  # by kind; kinds without one add nothing

    def column(self, mask: Column) -> Column:
        return reduce(lambda a, b: a + b, [t.column(mask) for t in self.trees], F.lit(self.prior))

    def values(self, bits: np.ndarray) -> np.ndarray:
        return self.prior + sum((t.values(bits) for t in self.trees), np.zeros(len(bits)))


def _best(bits, rows, g, h) -> tuple[int, float]:
    """The feature whose answer splits the rows with the greatest gain, and the gain."""
    part = lambda a, b: a * a / (b + DAMPING)
    g1, h1 = (x[rows] @ bits[rows] for x in (g, h))
    g_all, h_all = g[rows].sum(), h[rows].sum()
    gain = part(g1, h1) + part(g_all - g1, h_all - h1) - part(g_all, h_all)
    return int(gain.argmax()), float(gain.max()) if rows.any() else 0.0


def boosted(masks: np.ndarray, n: np.ndarray, positive: np.ndarray) -> PiiModel:
    """Newton boosting of the logistic loss on counts by feature pattern."""
    bits = (masks[:, None] >> np.arange(FEATURES) & 1).astype(bool)
    share = (positive.sum() + 0.5) / (n.sum() + 1)
    model = PiiModel(math.log(share / (1 - share)))
    score = np.full(len(masks), model.prior)
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-score))
        g, h = positive - n * p, n * p * (1 - p)
        root, gain = _best(bits, np.ones(len(masks), bool), g, h)
        if gain <= 1e-6:
            break
        yes = bits[:, root]
        asked = [_best(bits, side, g, h)[0] if side.any() else 0 for side in (~yes, yes)]
        leaves = []
        for side, feature in ((~yes, asked[0]), (yes, asked[1])):
            for answer in (False, True):
                at = side & (bits[:, feature] == answer)
                leaves.append(float(RATE * g[at].sum() / (h[at].sum() + DAMPING)))
        tree = Tree(root, asked[0], asked[1], tuple(leaves))
        model.trees.append(tree)
        score = score + tree.values(bits)
    return model


def fit_pii(docs: DataFrame) -> PiiModel:
    """Trees and thresholds from the candidates of all documents; half of them, by a hash of the text, calibrate.

    Candidates that a base span covers teach nothing as they stand, as they are never added; they do in their made forms.
    """
    given = F.transform(F.filter("_pii_found", lambda x: ~x["covered"]), lambda x: F.struct(x["kind"].alias("kind"), x["mask"].alias("mask"), x["assigned"].alias("label")))
    made = F.transform("_pii_made", lambda x: F.struct(x["kind"].alias("kind"), x["mask"].alias("mask"), F.lit(True).alias("label")))
    found = with_candidates(docs.select("text"), examples=True).select(F.explode(F.concat(given, made)).alias("c"), (F.crc32(F.col("text").cast("binary")) % 2).alias("fold"))
    counts = found.groupBy("c.kind", "c.mask", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("c.label").cast("long")).alias("positive")).collect()
    rows = np.array([(r.kind, r.mask, r.fold, r.n, r.positive) for r in counts], np.int64).reshape(-1, 5)
    kind, mask, fold, n, positive = rows.T
    fit = fold == 0
    model = boosted(mask[fit], n[fit], positive[fit])
    bits = (mask[:, None] >> np.arange(FEATURES) & 1).astype(bool)
    score = model.values(bits)
    for k in np.unique(kind):
        mine = (kind == k) & ~fit
        order = np.argsort(-score[mine], kind="stable")
        upto, right, s = np.cumsum(n[mine][order]), np.cumsum(positive[mine][order]), score[mine][order]
        last = np.append(s[1:] != s[:-1], True)  # a threshold takes all of an equal score
        good = np.flatnonzero(last & (right + 1 >= PRECISION * (upto + 2)))
        if len(good):
            model.thresholds[int(k)] = float(s[good[-1]])
    return model


@names_apart("_pii_")
def find_pii(docs: DataFrame, model: PiiModel) -> DataFrame:
    """``docs`` with base and spans: arrays of start, end (exclusive, in code points) and kind, by start and kind.

    ``base``: the strict detectors' spans. ``spans``: these and the candidates that the model selects, unless they
    overlap a base span. Null and empty texts have none, however long a text is it is searched whole, repeated rows get equal
    spans, and an empty table gives an empty one. Columns of these two names are replaced.
    """
    chosen = F.array().cast("array<struct<start:int,end:int,kind:int>>")
    if model.thresholds:
        def selected(x: Column) -> Column:
            score = model.column(x["mask"])
            return ~x["covered"] & reduce(lambda a, b: a | b, [(x["kind"] == k) & (score >= t - 1e-9) for k, t in model.thresholds.items()])

        chosen = F.transform(F.filter("_pii_found", selected), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
    order = lambda spans: F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))
    out = with_candidates(docs.drop("base", "spans")).withColumns({"base": order(F.col("_pii_base")), "spans": order(F.concat(F.col("_pii_base"), chosen))})
    return out.drop("_pii_base", "_pii_found")


def _named(kind: Column) -> Column:
    return F.element_at(F.array(*[F.lit(k) for k in KINDS]), kind + 1)


def redact(docs: DataFrame, model: PiiModel) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets (of overlapping spans, the first)."""
    found = find_pii(docs, model)
    empty = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        gap = F.concat(F.substr(F.col("text"), acc["at"] + 1, x["start"] - acc["at"]), F.lit("["), _named(x["kind"]), F.lit("]"))
        return F.when(x["start"] >= acc["at"], F.struct(x["end"].alias("at"), F.concat(acc["out"], gap).alias("out"))).otherwise(acc)

    return found.withColumn("text", F.aggregate("spans", empty, add, lambda acc: F.concat(acc["out"], F.substr(F.col("text"), acc["at"] + 1)))).drop("base", "spans")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents; n_spans counts the base spans and those that the trees add."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_pii(docs, fit_pii(docs))
    said = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", _named(x["kind"]), x["start"], x["end"])), ",")
    counts = [_count(i).alias(f"n_{KINDS[i]}") for i in range(4)]
    return found.select("doc_id", *counts, F.sha2(said(F.col("base")).cast("binary"), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
