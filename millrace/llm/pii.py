"""Personal data: base patterns, and candidates that boosted trees accept.

Base kinds (email, ip, card, phone) are found by pattern and check. Beside them, high-recall generators propose spans
that may overlap: long runs of letters and digits, the pieces of such runs between any signs, values assigned to a secret-like name, groups of digits. Gradient
boosted trees over format and context features score each proposal, and a threshold per kind, calibrated on held-out
examples, selects what is redacted; base spans stay and win over proposals they overlap.

There are no labelled spans in the tables, so the trees learn from examples of a seeded generator of formats (LEARN
below); what is shipped is a nested CASE expression of a fixed size. Spans are found, scored and joined with Spark SQL
functions alone. Offsets are code points, end exclusive.
"""

from __future__ import annotations

import functools
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.quality import let
from millrace.llm.store import hold, release

BASE = ("email", "ip", "card", "phone")
EXTRA = ("secret", "contact")
#: Each starts where a run of its characters starts or the match before ends, so no run is tried from its middle.
#: Possessive groups loop where plain ones recurse, so a name of very many labels takes no stack.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: A run of 16 to 19 digits; a longer or shorter one fails whole.
_CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Generators of proposals.
_RUN = r"(?<![A-Za-z0-9_/+=.@-])(?=[A-Za-z_/+=-]*+[0-9])[A-Za-z0-9_/+=-]{12,}+"
#: A piece of such a run, or of an address: it may follow a dot, a slash or any other sign.
_PIECE = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{16,}+"
_ASSIGNED = r"(?i)(?<![a-z])(?:password|passwd|pwd|passphrase|token|secret|api[_-]?key|access[_-]?key|auth)[\x20]{0,2}[:=][\x20]{0,2}[\"']?[^\s\"',;]{6,}+"
_VALUE = r"[:=][\x20]{0,2}[\"']?([^\s\"',;]{6,}+)$"
_DIGITS = r"(?<![0-9A-Za-z+.,-])\(?[0-9]{2,4}\)?[\x20.-][0-9]{2,4}(?:[\x20.-][0-9]{2,6}){1,3}(?![0-9A-Za-z-])"
_KEYED = r"(?i)(?:password|passwd|pwd|passphrase|token|secret|key|auth)[a-z_\x20]{0,8}[:=]?[\x20]{0,2}[\"']?$"
_REACHED = r"(?i)(?:phone|mobile|cell|call|tel|fax|contact|whatsapp|ssn|social security)[a-z#]{0,8}[.:\x20]{0,3}(?:no|number|at|is|me|us)?[.:\x20]{0,3}$"


def found(text: Column, pattern: str, before: int = 0) -> Column:
    """All matches as structs (start, end, m: the match, c: up to `before` characters ahead of it)."""

    none = F.array().cast("array<struct<start:int,end:int,m:string,c:string>>")

    def added(xs: Column) -> Column:
        return F.aggregate(xs, F.lit(0), lambda a, x: a + x)

    def place(matches: Column) -> Column:
        last = F.size(matches) - 1

        def with_gaps(gaps: Column) -> Column:
            # Lengths up to each match are added up by blocks of 64, so a text of very many takes no long sums.
            steps = F.transform(F.sequence(F.lit(0), last), lambda i: F.length(F.get(gaps, i)) + F.length(F.get(matches, i)))

            def with_steps(step: Column) -> Column:
                blocks = F.transform(F.sequence(F.lit(0), F.floor(last / 64).cast("int")), lambda b: added(F.slice(step, b * 64 + 1, F.lit(64))))
                heads = let(blocks, lambda bs: F.transform(bs, lambda _, b: added(F.slice(bs, F.lit(1), b))))

                def one(i: Column, head: Column) -> Column:
                    m, gap = F.get(matches, i), F.get(gaps, i)
                    block = F.floor(i / 64).cast("int")
                    before_ = F.get(head, block) + added(F.slice(step, block * 64 + 1, i - block * 64)) + F.length(gap)
                    return let(before_, lambda start: F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("m"), F.right(gap, F.lit(before)).alias("c")))

                return let(heads, lambda head: F.transform(F.sequence(F.lit(0), last), lambda i: one(i, head)))

            return let(steps, with_steps)

        return F.when(F.size(matches) == 0, none).otherwise(let(F.split(text, pattern, -1), with_gaps))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), place)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    ds = F.split(F.reverse(_digits(m)), "")
    ds = F.filter(ds, lambda d: d != "")
    total = F.aggregate(F.transform(ds, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0))), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def _spans(places: Column, kind: str) -> Column:
    rank = (*BASE, *EXTRA).index(kind)
    return F.transform(places, lambda s: F.struct(F.lit(rank).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def base_spans(text: Column) -> Column:
    """Spans of the base kinds, by kind and start, as structs (rank, start, end, kind)."""
    email = found(text, _EMAIL)
    ip = F.filter(found(text, _IP), lambda s: F.forall(F.split(s["m"], r"\."), lambda x: F.coalesce(F.when(F.length(F.ltrim(x, F.lit("0"))) > 3, F.lit(999)).otherwise(F.ltrim(x, F.lit("0")).try_cast("int")), F.lit(0)) <= 255))
    card = F.filter(found(text, _CARD), lambda s: _luhn(s["m"]))
    phone = F.filter(found(text, _PHONE), lambda s: F.length(_digits(s["m"])).between(8, 15))
    return F.concat(*(_spans(x, k) for x, k in zip((email, ip, card, phone), BASE, strict=True)))


# Features, in Spark and, for the examples, in Python.

FEATURES = ("length", "digits", "uppers", "lowers", "others", "distinct", "keyed", "reached", "groups", "hex")


def features(m: Column, c: Column) -> list[Column]:
    n = F.length(m)

    def of(chars: str) -> Column:
        return (F.length(F.regexp_replace(m, f"[^{chars}]", ""))).cast("double")

    letters = of("A-Z") + of("a-z")
    return [
        n.cast("double"), of("0-9"), of("A-Z"), of("a-z"), n - letters - of("0-9"), F.size(F.array_distinct(F.split(m, ""))).cast("double"),
        c.rlike(_KEYED).cast("double"), c.rlike(_REACHED).cast("double"), F.regexp_count(m, F.lit("[0-9]+")).cast("double"), m.rlike("^[0-9a-fA-F]+$").cast("double"),
    ]


def features_of(m: str, c: str) -> list[float]:
    def of(chars: str) -> int:
        return len(re.sub(f"[^{chars}]", "", m))

    return [len(m), of("0-9"), of("A-Z"), of("a-z"), len(m) - of("A-Za-z0-9"), len(set(m)), bool(re.search(_KEYED, c)), bool(re.search(_REACHED, c)), len(re.findall("[0-9]+", m)), bool(re.match("^[0-9a-fA-F]+$", m))]


def examples(n: int = 4000, seed: int = 7) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """LEARN: features and labels of generated proposals, for secrets and for contacts."""
    rng = np.random.default_rng(seed)
    lower, upper, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"

    def some(chars: str, a: int, b: int | None = None) -> str:
        return "".join(rng.choice(list(chars), int(rng.integers(a, (b or a) + 1))))

    def word() -> str:
        return some(lower, 2, 9)

    keyed = ("password=", "token = \"", "api_key: ", "secret=", "auth: ")
    plain = ("see ", "the ", "of the ", "in ", "chapter ", "", "page ")
    reached = ("call me at ", "phone: ", "mobile ", "tel. ", "ssn ", "contact us at ")
    secret = (  # (proposal, context ahead, label)
        lambda: (some("0123456789abcdef", 16, 64), rng.choice(keyed), 1), lambda: (some(lower + digit, 8, 20) + some(digit, 1), rng.choice(keyed), 1),
        lambda: (some(upper, 4) + some(upper + digit, 15, 16) + some(digit, 1), rng.choice(plain), 1), lambda: (some(lower + upper + digit + "+/", 30, 60) + some(digit, 2), rng.choice(plain), 1),
        lambda: (some("0123456789abcdef", 40, 64) + some(digit, 1), rng.choice(plain), 1),
        lambda: (word() + "-" + word() + "-" + some(digit, 1, 4), rng.choice(plain), 0), lambda: (word() + word() + word() + some(digit, 1, 3), rng.choice(plain), 0),
        lambda: (some(digit, 12, 22), rng.choice(plain), 0), lambda: (some(digit, 4) + "-" + some(digit, 2) + "-" + some(digit, 2) + "T" + some(digit, 4), rng.choice(plain), 0),
        lambda: (word() + "/" + word() + "/" + word() + some(digit, 1, 2), rng.choice(plain), 0), lambda: (word().capitalize() + word().capitalize() + some(digit, 2, 4) + word(), rng.choice(plain), 0),
        lambda: (word() + "_" + word() + "_" + some(digit, 1, 2) + word(), rng.choice(plain), 0), lambda: ("=" * int(rng.integers(10, 30)) + some(digit, 1), rng.choice(plain), 0),
        lambda: ("-".join(word() if rng.random() < 0.7 else some(digit, 1, 4) for _ in range(int(rng.integers(4, 9)))) + "-" + some(digit, 1, 4), rng.choice(plain), 0),
        lambda: ("/".join(word() for _ in range(int(rng.integers(3, 7)))) + some(digit, 1) + "/" + word().capitalize() + some(digit, 1), rng.choice(plain), 0),
    )
    contact = (
        lambda: (f"({some(digit, 3)}) {some(digit, 3)}-{some(digit, 4)}", rng.choice(plain + reached), 1), lambda: (f"{some(digit, 3)}-{some(digit, 3)}-{some(digit, 4)}", rng.choice(reached), 1),
        lambda: (f"{some(digit, 3)}-{some(digit, 2)}-{some(digit, 4)}", rng.choice(plain + reached), 1), lambda: (f"{some(digit, 3)} {some(digit, 3)} {some(digit, 4)}", rng.choice(reached), 1),
        lambda: (f"{some(digit, 4)}-{some(digit, 2)}-{some(digit, 2)}", rng.choice(plain), 0), lambda: (f"{some(digit, 2)}.{some(digit, 2)}.{some(digit, 4)}", rng.choice(plain), 0),
        lambda: (" ".join(some(digit, 2, 4) for _ in range(3)), rng.choice(plain), 0), lambda: (" ".join(some(digit, 2, 4) for _ in range(4)), rng.choice(plain), 0),
        lambda: (f"{some(digit, 3)}.{some(digit, 3)}.{some(digit, 3)}", rng.choice(plain), 0), lambda: ("-".join(some(digit, 2, 4) for _ in range(4)), rng.choice(plain), 0),
    )
    x, y = {}, {}
    for kind, makers in (("secret", secret), ("contact", contact)):
        rows = [makers[int(rng.integers(len(makers)))]() for _ in range(n)]
        x[kind] = np.array([features_of(m, str(word() + " " + c)) for m, c, _ in rows], float)
        y[kind] = np.array([t for _, _, t in rows], float)
    return x, y


def boost(x: np.ndarray, y: np.ndarray, trees: int = 24, rate: float = 0.3, depth: int = 3, least: int = 20) -> tuple[float, list]:
    """Logistic gradient boosting: (prior, trees); a tree is a value or (feature, threshold, at most, above)."""
    prior = float(np.log(y.mean() / (1 - y.mean())))
    raw, out = np.full(len(y), prior), []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, left: int):
        leaf = float(rate * g[rows].sum() / (h[rows].sum() + 1))
        best = None
        if left:
            for f in range(x.shape[1]):
                v = x[rows, f]
                for t in np.unique(np.quantile(v, np.linspace(0.05, 0.95, 19))):
                    a = v <= t
                    if least <= a.sum() <= len(rows) - least:
                        gain = sum(g[rows[s]].sum() ** 2 / (h[rows[s]].sum() + 1) for s in (a, ~a))
                        if best is None or gain > best[0] + 1e-9:
                            best = (gain, f, float(t), a)
        if best is None:
            raw[rows] += leaf
            return leaf
        _, f, t, a = best
        return f, t, grow(rows[a], g, h, left - 1), grow(rows[~a], g, h, left - 1)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        out.append(grow(np.arange(len(y)), y - p, p * (1 - p), depth))
    return prior, out


def raw_score(model: tuple[float, list], x: np.ndarray) -> np.ndarray:
    def run(tree, row):
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return tree

    return np.array([model[0] + sum(run(t, row) for t in model[1]) for row in x])


@functools.cache
def models(precision: float = 0.995) -> dict[str, tuple[tuple[float, list], float]]:
    """Per kind, the trees and the threshold on the raw score: the lowest at which that share of the held-out quarter
    of the examples that pass is right."""
    x, y = examples()
    out = {}
    for kind in EXTRA:
        cut = len(y[kind]) * 3 // 4
        model = boost(x[kind][:cut], y[kind][:cut])
        held, truth = raw_score(model, x[kind][cut:]), y[kind][cut:]
        order = np.argsort(-held)
        right = np.cumsum(truth[order]) / np.arange(1, len(order) + 1)
        good = np.flatnonzero(right >= precision)
        out[kind] = (model, float(held[order[good[-1]]]) if len(good) else float("inf"))
    return out


def _accepted(places: Column, kind: str) -> Column:
    """Proposals that the trees of a kind accept, as structs (rank, start, end, kind, score)."""
    model, threshold = models()[kind]
    rank = (*BASE, *EXTRA).index(kind)
    scored = F.transform(places, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), let(F.array(*features(s["m"], s["c"])), lambda f: _raw(model, f)).alias("score")))
    good = F.filter(scored, lambda s: s["score"] >= threshold)
    return F.transform(good, lambda s: F.struct(F.lit(rank).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["score"].alias("score")))


def _raw(model: tuple[float, list], f: Column) -> Column:
    def value(tree) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(float(tree))
        i, t, a, b = tree
        return F.when(F.get(f, F.lit(i)) <= t, value(a)).otherwise(value(b))

    total = F.lit(model[0])
    for tree in model[1]:
        total = total + value(tree)
    return total


def extra_spans(text: Column, base: Column) -> Column:
    """Accepted proposals that overlap no base span and no better one that is taken, as structs (rank, start, end, kind)."""
    run = F.concat(found(text, _RUN, 24), found(text, _PIECE, 24))
    assigned = F.transform(found(text, _ASSIGNED, 1), lambda s: let(F.regexp_extract(s["m"], _VALUE, 1), lambda v: F.struct((s["end"] - F.length(v)).alias("start"), s["end"].alias("end"), v.alias("m"), F.right(F.left(s["m"], F.length(s["m"]) - F.length(v)), F.lit(24)).alias("c"))))
    assigned = F.filter(assigned, lambda s: s["end"] > s["start"])
    digits = found(text, _DIGITS, 24)
    accepted = F.concat(_accepted(F.concat(run, assigned), "secret"), _accepted(digits, "contact"))

    none = F.array().cast("array<struct<rank:int,start:int,end:int,kind:string>>")

    def meets(a: Column, b: Column) -> Column:
        return (a["start"] < b["end"]) & (b["start"] < a["end"])

    def select(all_: Column) -> Column:
        """Those that meet no base span, taken by falling score unless one that meets them is already in."""
        rest = F.filter(all_, lambda s: ~F.exists(base, lambda o: meets(o, s)))
        order = F.array_sort(F.transform(rest, lambda s: F.struct((-s["score"]).alias("worse"), s["start"].alias("start"), s["end"].alias("end"), s["rank"].alias("rank"), s["kind"].alias("kind"))))
        kept = F.aggregate(order, none, lambda a, s: F.when(F.exists(a, lambda o: meets(o, s)), a).otherwise(F.concat(a, F.array(F.struct(s["rank"], s["start"], s["end"], s["kind"])))))
        return kept

    return let(accepted, lambda a: F.when(F.size(a) == 0, none).otherwise(select(a)))


def find(docs: DataFrame) -> DataFrame:
    """docs (with text) and base_spans, spans: arrays of (rank, start, end, kind) by kind, then start.

    Null and empty texts have none; repeated rows are each treated alike; an empty table gives an empty table.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    out = hold(docs, "text").withColumn("_t", t).withColumn("base_spans", base_spans(F.col("_t")))
    out = out.withColumn("spans", F.array_sort(F.concat("base_spans", extra_spans(F.col("_t"), F.col("base_spans")))))
    return release(out, docs.columns, "base_spans", "spans")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(found_: DataFrame) -> DataFrame:
    """The rows of find() with each span of the text replaced by its kind in angle brackets; texts without spans stay
    as they are. Overlapping spans are replaced together, by the first one's kind."""
    by_start = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"], s["end"], s["kind"])))

    def step(a: Column, s: Column) -> Column:
        fresh = s["start"] >= a["at"]
        piece = F.concat(F.col("text").substr(a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0))), F.lit("<"), s["kind"], F.lit(">"))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(fresh, F.concat(a["out"], piece)).otherwise(a["out"]).alias("out"))

    text = F.aggregate(by_start, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.col("text").substr(a["at"] + 1, F.length("text"))))
    return found_.withColumn("text", F.when(F.size("spans") > 0, text).otherwise(F.col("text"))).drop("base_spans", "spans")
