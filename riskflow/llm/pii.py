"""Personal data by candidate gradient boosting, in DataFrame functions.

Base rules find spans that are personal data by their form alone (``BASE``); these always
stay. Beside them, high-recall generators (``GENERATORS``) propose overlapping candidates:
addresses written with blanks or [at] and [dot], and runs of digits with any separators. Each
candidate has format features (digits, separators, groups, checks) and context features (a
cue word before it, letters or digits at its edges). Boosted trees score it, and it is taken if its
score reaches its kind's threshold and it overlaps neither a base span nor a better candidate.

The trees are trained with the base rules as weak labels. A candidate is positive if it is a base
span of its kind, or a base span written in another form where it stands (``rewritten``: [at] and [dot] in
addresses, a phone number without its plus, a card with other separators), which the base
rules do not match; what only tells the rules apart, a leading plus, is not a feature. Thresholds are
calibrated by kind on the documents of a held-out hash fold: the lowest score, in steps of 1 / ``STEPS``, at which at least
``PRECISION`` of the candidates, rewritten ones included, are positives, or none. Training and calibration see every
candidate of every text, counted by their bins (``train``); the trees become one SQL expression, and scoring covers every whole
text in one pass, without Python or a shuffle.

Positions are code points, from the lengths of the matches and of the texts between them.
The base patterns are written so that Java's matcher takes linear time and no recursion; they match as the
plain forms do.

Defined results: null text is empty; without positives or negatives among the candidates
nothing is added; repeated rows get equal results.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from riskflow.llm import common
from riskflow.operators.materialize import materialize

KINDS = ("email", "ip", "card", "phone")
CELLS_HELD = 30_000         # counted cells that the driver learns from by itself
PRECISION = 0.99
STEPS = 10_000              # thresholds are multiples of 1 / STEPS
TREES, DEPTH, RATE = 30, 3, 0.3
SHARES = np.linspace(0, 1, 33)[1:-1]
BINS = len(SHARES) + 1

_LOCAL = "[A-Za-z0-9._%+-]"
_HOST = "[A-Za-z0-9-]"
#: kind -> (pattern, cheap test that holds wherever the pattern can match)
BASE = {
    "email": (rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++", lambda t: t.contains("@")),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", lambda t: t.rlike(r"[0-9]\.[0-9]")),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){15}")),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: t.contains("+")),
}
#: (pattern, test); the kind follows from the form
GENERATORS = (
    (rf"{_LOCAL}{{1,64}} ?(?:@|[\[(]at[\])]) ?{_HOST}++(?: ?(?:\.|[\[(]dot[\])]) ?{_HOST}++)++",
     lambda t: t.contains("@") | t.contains("[at]") | t.contains("(at)")),
    (r"(?<![0-9])[+(]?[0-9][0-9\x20().-]{4,40}[0-9]", lambda t: t.rlike(r"[0-9][0-9\x20().-]{4}")),
    (r"(?<![0-9])[0-9][0-9.-]{5,30}[0-9]", lambda t: t.rlike(r"[0-9][0-9.-]{5}")),
)
CUES = r"(?i)(?:tel|phone|fon|call|mobil|fax|mail|contact|card|visa|konto|carte|tarjeta|addr|host|ip)[^A-Za-z0-9]{0,4}$"
FEATURES = ("kind", "length", "digits", "dots", "blanks", "dashes", "parens", "signs", "groups", "longest_group",
            "luhn", "octets", "cue", "glued_before", "glued_after", "letters")
SPAN = "array<struct<kind:int,start:int,end:int>>"


def located(text: Column, pattern: str, test: Column) -> Column:
    """All matches of ``pattern``, left to right: array of (start, end, m)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pieces = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(
        F.length(g).alias("g"), F.length(m).alias("n"), m.alias("m")))
    none = F.array().cast("array<struct<start:int,end:int,m:string>>")
    folded = F.aggregate(
        pieces, F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda s, p: F.struct((s["at"] + p["g"] + p["n"]).alias("at"), F.concat(s["out"], F.array(F.struct(
            (s["at"] + p["g"]).alias("start"), (s["at"] + p["g"] + p["n"]).alias("end"), p["m"].alias("m")))).alias("out")),
        lambda s: s["out"])
    return F.when(test, folded).otherwise(none)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Does a string of digits (at most 40) pass the Luhn check?"""
    n = F.length(digits)
    total = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda s, i: s + F.when(
        (n - i) % 2 == 0, F.substring(digits, i, F.lit(1)).cast("int")).otherwise(
        F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), F.substring(digits, i, F.lit(1)).cast("int") + 1)))
    return F.coalesce((n > 0) & (total % 10 == 0), F.lit(False))


def _octets(m: Column) -> Column:
    """Are the dot-separated parts numbers of at most 255 (leading zeros allowed)?"""
    def small(p: Column) -> Column:
        bare = F.regexp_replace(p, "^0+", "")
        return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))
    return F.forall(F.split(m, r"\.", -1), small)


def base_spans(text: Column) -> Column:
    """The spans of the base rules, by kind, then start."""
    keep = {
        "email": lambda m: F.lit(True), "ip": _octets,
        "card": lambda m: F.when(F.length(_digits(m)).between(16, 19), luhn(_digits(m))).otherwise(False),
        "phone": lambda m: F.length(_digits(m)).between(8, 15),
    }
    def of_kind(number: int, kind: str) -> Column:
        pattern, test = BASE[kind]
        good = F.filter(located(text, pattern, test(text)), lambda s: keep[kind](s["m"]))
        return F.transform(good, lambda s: F.struct(
            F.lit(number).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    return F.concat(*[of_kind(number, kind) for number, kind in enumerate(KINDS)])


def candidates(text: Column) -> Column:
    """The generators' proposals: array of (kind, start, end, and FEATURES as doubles in ``x``)."""
    found = F.concat(*[located(text, pattern, test(text)) for pattern, test in GENERATORS])

    def described(s: Column) -> Column:
        m, d = s["m"], _digits(s["m"])
        count = lambda chars: F.length(F.regexp_replace(m, f"[^{chars}]", ""))
        dots = count(".")
        is_mail = m.contains("@") | m.contains("at]") | m.contains("at)")
        kind = F.when(is_mail, 0).when((dots == 3) & (F.length(d) <= 12), 1).when(F.length(d) >= 15, 2).otherwise(3)
        groups = F.array_remove(F.split(m, "[^0-9]+", -1), "")
        before = F.substring(text, F.greatest(s["start"] - 15, F.lit(1)), F.least(s["start"], F.lit(16)))
        values = {
            "kind": kind, "length": s["end"] - s["start"], "digits": F.length(d), "dots": dots, "blanks": count(r"\x20"),
            "dashes": count(r"\-"), "parens": count("()"), "signs": count("@"), "groups": F.size(groups),
            "longest_group": F.coalesce(F.array_max(F.transform(groups, lambda g: F.length(g))), F.lit(0)),
            "luhn": F.when(F.length(d).between(12, 40), luhn(d)).otherwise(False).cast("int"),
            "octets": F.when(dots == 3, _octets(m)).otherwise(False).cast("int"),
            "cue": before.rlike(CUES).cast("int"), "glued_before": before.rlike("[A-Za-z0-9]$").cast("int"),
            "glued_after": F.substring(text, s["end"] + 1, F.lit(1)).rlike("[A-Za-z0-9]").cast("int"),
            "letters": count("A-Za-z"),
        }
        return F.struct(kind.alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
                        F.array(*[values[f].cast("double") for f in FEATURES]).alias("x"))

    return F.array_distinct(F.transform(found, described))


def rewritten(m: Column, kind: Column, form: Column) -> Column:
    """A base span in another form that people use; null if its kind has none. ``form`` picks one of two."""
    user, host = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    mail = F.when(form == 0, F.concat(user, F.lit(" [at] "), F.replace(host, F.lit("."), F.lit(" [dot] ")))).otherwise(
        F.concat(user, F.lit("(at)"), host))
    digits = _digits(m)
    card = F.when(form == 0, F.regexp_replace(digits, "(.{4})(?=.)", "$1.")).otherwise(F.regexp_replace(digits, "(.{4})(?=.)", "$1 - "))
    phone = F.when(form == 0, F.substring(m, 2, 1 << 30)).otherwise(F.concat(F.lit("00"), F.substring(m, 2, 1 << 30)))
    return F.when(kind == 0, mail).when(kind == 2, card).when(kind == 3, phone)


def rewritten_candidates(picked: DataFrame) -> DataFrame:
    """(spot, start, x, y) of (spot, text, base): candidates that are exactly a rewritten base span, all positives."""
    near = 40
    spans = picked.select("spot", "text", F.explode("base").alias("b"))
    form = F.pmod(F.xxhash64("spot", "b.start"), F.lit(2))
    m = F.substring(F.col("text"), F.col("b.start") + 1, F.col("b.end") - F.col("b.start"))
    before = F.substring(F.col("text"), F.greatest(F.col("b.start") - near, F.lit(0)) + 1, F.least(F.col("b.start"), F.lit(near)))
    after = F.substring(F.col("text"), F.col("b.end") + 1, F.lit(near))
    shown = (spans.select("spot", "b", rewritten(m, F.col("b.kind"), form).alias("m"), before.alias("before"), after.alias("after"))
             .filter("m is not null"))
    return (shown.select("spot", "b", F.length("before").alias("first"), F.length("m").alias("n"),
                         F.explode(candidates(F.concat("before", "m", "after"))).alias("c"))
            .filter("c.kind = b.kind and c.start = first and c.end = first + n")
            .select("spot", F.col("b.start").alias("start"), F.col("c.x").alias("x"), F.lit(1).alias("y")))


class Trees:
    """Boosted trees on the log-odds; a tree is nested (feature, cut, below, above) or a leaf."""

    def __init__(self, start: float, trees: list, thresholds: dict[int, float]):
        self.start, self.trees, self.thresholds = start, trees, thresholds

    def column(self, x: Column) -> Column:
        def node(tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(float(tree))
            f, cut, below, above = tree
            return F.when(F.get(x, F.lit(f)) <= cut, node(below)).otherwise(node(above))
        total = F.lit(self.start)
        for tree in self.trees:
            total = total + node(tree)
        return 1 / (1 + F.exp(-total))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.total(x)))

    def total(self, x: np.ndarray) -> np.ndarray:
        def node(tree, rows: np.ndarray) -> np.ndarray:
            if not isinstance(tree, tuple):
                return np.full(len(rows), float(tree))
            f, cut, below, above = tree
            low, out = rows[:, f] <= cut, np.empty(len(rows))
            out[low], out[~low] = node(below, rows[low]), node(above, rows[~low])
            return out
        return self.start + sum((node(t, x) for t in self.trees), np.zeros(len(x)))


def _open_nodes(tree, bins: np.ndarray) -> np.ndarray:
    """The number of the open node where every row ends, -1 at a leaf. In a growing tree an open node
    is its number (int), a leaf its value (float)."""
    out = np.full(len(bins), -1)

    def walk(node, rows: np.ndarray) -> None:
        if isinstance(node, tuple):
            f, cut, below, above = node
            low = bins[rows, f] <= cut
            walk(below, rows[low])
            walk(above, rows[~low])
        elif isinstance(node, int):
            out[rows] = node

    walk(tree, np.arange(len(bins)))
    return out


def _closed(tree, instead: list):
    """A growing tree with its open nodes replaced."""
    if isinstance(tree, tuple):
        return tree[0], tree[1], _closed(tree[2], instead), _closed(tree[3], instead)
    return instead[tree] if isinstance(tree, int) else tree


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Cell of every row: each feature's bin (the cuts below its value), and the kind."""
    out = np.empty((len(x), len(cuts) + 1), int)
    for f, places in enumerate(cuts):
        out[:, f] = np.searchsorted(places, x[:, f])
    out[:, -1] = x[:, 0]
    return out


class Held:
    """Sums over cells (bins by feature, then the kind) that are in memory, with their negatives and positives."""

    def __init__(self, cells: np.ndarray, no: np.ndarray, yes: np.ndarray, held_out: np.ndarray):
        self.kept, self.other = [(cells[fold], no[fold], yes[fold]) for fold in (~held_out, held_out)]

    def totals(self) -> tuple[float, float]:
        return self.kept[1].sum(), self.kept[2].sum()

    def by_bin(self, model: Trees, tree, nodes: int) -> np.ndarray:
        """Gradients, curvatures and numbers of the training fold: [3, feature, open node, bin]."""
        cells, no, yes = self.kept
        p, spots = model.predict(cells), _open_nodes(tree, cells)
        here = spots >= 0
        return np.array([[np.bincount(spots[here] * BINS + cells[here, f], w[here], nodes * BINS).reshape(nodes, BINS)
                          for f in range(len(FEATURES))] for w in (no * p + yes * (p - 1), (no + yes) * p * (1 - p), no + yes)])

    def by_score(self, model: Trees) -> np.ndarray:
        """Positives and numbers of the held-out fold: [2, kind, step of the score]."""
        cells, no, yes = self.other
        spots = cells[:, -1] * (STEPS + 1) + np.floor(model.predict(cells) * STEPS).astype(int)
        return np.array([np.bincount(spots, w, len(KINDS) * (STEPS + 1)).reshape(-1, STEPS + 1) for w in (yes, no + yes)])


class Spread:
    """The same sums over a table of any number of cells: an aggregate each."""

    def __init__(self, cells: DataFrame):
        self.kept, self.other = cells.filter("not held_out"), cells.filter("held_out")

    def totals(self) -> tuple[float, float]:
        return tuple(self.kept.agg(F.sum("no").cast("double"), F.sum("yes").cast("double")).first())

    def by_bin(self, model: Trees, tree, nodes: int) -> np.ndarray:
        def node(part) -> Column:
            if not isinstance(part, tuple):
                return F.lit(part if isinstance(part, int) else -1)
            return F.when(F.get("cell", F.lit(part[0])) <= part[1], node(part[2])).otherwise(node(part[3]))

        p, n = F.col("p"), F.col("no") + F.col("yes")
        spread = (self.kept.select("*", model.column(F.col("cell")).alias("p"), node(tree).alias("node")).filter("node >= 0")
                  .select("node", (n * p - F.col("yes")).alias("g"), (n * p * (1 - p)).alias("h"), n.alias("n"),
                          F.posexplode(F.slice("cell", 1, len(FEATURES))).alias("f", "bin")))
        out = np.zeros((3, len(FEATURES), nodes, BINS))
        for r in spread.groupBy("f", "node", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).collect():
            out[:, r["f"], r["node"], r["bin"]] = r["g"], r["h"], r["n"]
        return out

    def by_score(self, model: Trees) -> np.ndarray:
        step = F.floor(model.column(F.col("cell")) * STEPS).cast("int")
        out = np.zeros((2, len(KINDS), STEPS + 1))
        for r in (self.other.groupBy(F.get("cell", F.lit(len(FEATURES))).alias("kind"), step.alias("step"))
                  .agg(F.sum("yes").alias("yes"), F.sum(F.col("no") + F.col("yes")).alias("n")).collect()):
            out[:, r["kind"], r["step"]] = r["yes"], r["n"]
        return out


def boost(sums: Held | Spread, cuts: list[np.ndarray], trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Trees:
    """Gradient boosting with second-order leaf values, over bins (a cut is its place in ``cuts``). Trees
    grow level by level, from sums by node, feature and bin."""
    negatives, positives = sums.totals()
    share = np.clip(positives / (negatives + positives), 1e-3, 1 - 1e-3)
    model = Trees(float(np.log(share / (1 - share))), [], {})

    def best_cut(g: np.ndarray, h: np.ndarray, n: np.ndarray):
        best, found, parent = 1e-3, None, g[0].sum() ** 2 / (h[0].sum() + 1.0)
        for f, places in enumerate(cuts):
            gl, hl, nl = (np.cumsum(v[f])[:len(places)] for v in (g, h, n))
            gr, hr, nr = g[f].sum() - gl, h[f].sum() - hl, n[f].sum() - nl
            gain = np.where((nl >= 5) & (nr >= 5), gl ** 2 / (hl + 1) + gr ** 2 / (hr + 1) - parent, -1.0)
            if len(places) and gain.max() > best:
                at = int(gain.argmax())
                best, found = gain[at], (f, at, (gl[at], hl[at]), (gr[at], hr[at]))
        return found

    def value(g: float, h: float) -> float:
        return round(float(-rate * g / (h + 1.0)), 6)

    for _ in range(trees):
        tree, nodes = 0, 1
        for left in range(depth, 0, -1):
            g, h, n = sums.by_bin(model, tree, nodes)
            instead, opened = [], 0
            for k in range(nodes):
                found = best_cut(g[:, k], h[:, k], n[:, k]) if n[0, k].sum() >= 20 else None
                if found is None:
                    instead.append(value(g[0, k].sum(), h[0, k].sum()))
                elif left == 1:
                    instead.append((*found[:2], value(*found[2]), value(*found[3])))
                else:
                    instead.append((*found[:2], opened, opened + 1))
                    opened += 2
            tree, nodes = _closed(tree, instead), opened
            if not opened:
                break
        model.trees.append(tree)
    return model


def learn(sums: Held | Spread, cuts: list[np.ndarray]) -> Trees:
    """Boost on the training fold, calibrate each kind's threshold on the held-out fold."""
    model = boost(sums, cuts)
    hits, n = sums.by_score(model)
    for kind in range(len(KINDS)):
        hit, all_ = np.cumsum(hits[kind][::-1]), np.cumsum(n[kind][::-1])
        good = np.flatnonzero((n[kind][::-1] > 0) & (hit >= PRECISION * all_))
        if len(good) and hit[good[-1]] >= 10:
            model.thresholds[kind] = float(STEPS - good[-1]) / STEPS

    def at_values(tree):
        return tree if not isinstance(tree, tuple) else (tree[0], float(cuts[tree[0]][tree[1]]), at_values(tree[2]), at_values(tree[3]))

    model.trees = [at_values(t) for t in model.trees]
    return model


def fit(x: np.ndarray, y: np.ndarray, held_out: np.ndarray) -> Trees:
    """``learn`` from candidates held in memory."""
    kept = x[~held_out]
    if not len(kept) or y[~held_out].min() == y[~held_out].max():
        return Trees(0.0, [], {})
    cuts = [np.unique(np.quantile(kept[:, f], SHARES, method="lower")) for f in range(x.shape[1])]
    return learn(Held(binned(x, cuts), 1 - y, y, held_out), cuts)


def labelled(docs: DataFrame) -> DataFrame:
    """(x, held_out, no, yes): every candidate of every text, equal ones counted; written once."""
    spot = F.xxhash64("doc_id", "text")
    based = docs.select(spot.alias("spot"), "text", base_spans(F.col("text")).alias("base"))
    found = (based.select("spot", "base", F.explode(candidates(F.col("text"))).alias("c"))
             .select("spot", F.col("c.x").alias("x"),
                     F.exists("base", lambda b: (b["kind"] == F.col("c.kind")) & (b["start"] == F.col("c.start"))
                              & (b["end"] == F.col("c.end"))).cast("int").alias("y")))
    rows = found.union(rewritten_candidates(based).select("spot", "x", "y"))
    return materialize(rows.groupBy("x", (F.pmod("spot", F.lit(4)) == 0).alias("held_out"))
                       .agg(F.sum(1 - F.col("y")).alias("no"), F.sum("y").alias("yes")), "pii-candidates")


def quantile_cuts(kept: DataFrame, n: int) -> list[np.ndarray]:
    """The lower quantiles at ``SHARES`` of every feature over ``n`` counted candidates; exact."""
    places = F.array(*[F.lit(int((n - 1) * q)) for q in SHARES])
    values = (kept.select(F.posexplode("x").alias("f", "v"), (F.col("no") + F.col("yes")).alias("w"))
              .groupBy("f", "v").agg(F.sum("w").alias("w")))
    upto = F.sum("w").over(Window.partitionBy("f").orderBy("v"))     # one row per distinct value of a feature
    held = (values.withColumn("upto", upto).filter(F.exists(places, lambda p: (p < F.col("upto")) & (p >= F.col("upto") - F.col("w"))))
            .select("f", "v").collect())
    return [np.array(sorted(r["v"] for r in held if r["f"] == f)) for f in range(len(FEATURES))]


def _below(value: Column):
    return lambda cut: cut < value


def train(docs: DataFrame, most_held: int = CELLS_HELD) -> Trees:
    """Fit on every candidate of (doc_id, text).

    The trees cut at quantiles only, so candidates of equal bins are one cell with two counts, and the cells
    give the same trees as their candidates. Up to ``most_held`` cells come to the driver; of more, it
    gets each tree level's sums alone.
    """
    rows = labelled(docs)
    counts = rows.filter("not held_out").agg(F.sum("no"), F.sum("yes")).first()
    if not counts[0] or not counts[1]:
        return Trees(0.0, [], {})
    cuts = quantile_cuts(rows.filter("not held_out"), counts[0] + counts[1])
    value = [F.get("x", F.lit(f)) for f in range(len(FEATURES))]
    bins = [F.size(F.filter(F.array(*[F.lit(float(c)) for c in places]), _below(v))) for places, v in zip(cuts, value)]
    cells = materialize(rows.groupBy(F.array(*bins, value[0].cast("int")).alias("cell"), "held_out")
                        .agg(F.sum("no").alias("no"), F.sum("yes").alias("yes")), "pii-cells")
    if cells.count() > most_held:
        return learn(Spread(cells), cuts)
    found = cells.orderBy("cell", "held_out").collect()
    return learn(Held(*[np.array([r[c] for r in found]) for c in ("cell", "no", "yes", "held_out")]), cuts)


def added_spans(model: Trees, base: Column, proposed: Column) -> Column:
    """Candidates at or over their kind's threshold, clear of base spans and of better candidates."""
    if not model.thresholds:
        return F.array().cast(SPAN)
    need = F.create_map(*[F.lit(v) for item in sorted(model.thresholds.items()) for v in item])
    scored = F.transform(proposed, lambda c: F.struct((-model.column(c["x"])).alias("rank"), c["start"].alias("start"),
                                                      c["end"].alias("end"), c["kind"].alias("kind")))
    clear = F.filter(scored, lambda c: (-c["rank"] >= F.coalesce(F.try_element_at(need, c["kind"]), F.lit(2.0)))
                     & ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    return F.aggregate(F.array_sort(clear), F.array().cast(SPAN), lambda kept, c: F.when(
        F.exists(kept, lambda k: (k["start"] < c["end"]) & (c["start"] < k["end"])), kept).otherwise(
        F.concat(kept, F.array(F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))))))


def find(docs: DataFrame, model: Trees, text: str = "text", prefix: str = "pii_") -> DataFrame:
    """``docs`` with the columns pii_base and pii_added (or another prefix), arrays of (kind, start, end)."""
    col = F.coalesce(F.col(text).cast("string"), F.lit(""))
    base, proposed, added = (prefix + x for x in ("base", "proposed", "added"))
    return (docs.withColumns({base: base_spans(col), proposed: candidates(col)})
            .withColumn(added, added_spans(model, F.col(base), F.col(proposed))).drop(proposed))


def listed(spans: Column) -> Column:
    """kind:start:end of every span, by kind as listed, then start, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; overlapping spans are one, named by the first."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    folded = F.aggregate(
        ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(s["start"] >= a["at"], F.concat(
            a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.get(names, s["kind"]))).otherwise(a["out"]).alias("out")),
        lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return F.when(F.size(spans) == 0, text).otherwise(folded)


def op5_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents``; one row per document."""
    docs = common.id_and_text(common.table(spark, sf_dir, "documents"))
    found = find(docs, train(docs))
    count = lambda k: F.size(F.filter("pii_base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(listed(F.col("pii_base")), 256).alias("base_sha256"),
        listed(F.concat("pii_base", "pii_added")).alias("spans"),
        F.size("pii_added").cast("long").alias("n_added"))
