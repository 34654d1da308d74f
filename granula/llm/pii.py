"""Personal data: fixed rules, and boosted trees over spans that wider generators propose.

All on the JVM: patterns cut a text into gaps and matches, one fold over them gives places,
and the trees are compiled to CASE expressions over a candidate's features, so a document is
one row from its text to its spans and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granula.llm.common import batch_rows, materialize

KINDS = ("email", "ip", "card", "phone", "secret")
#: Fixed patterns of the base rules, as Java finds the same matches without trying a place twice.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have to be searched for a kind.
HINT = {"email": "@", "ip": "[0-9]", "card": "[0-9]", "phone": r"\+[0-9]", "secret": "[0-9]"}
WIDE_HINT = {"email": r"@|(?i:at)\x20?[\])}>]", "phone": "[0-9]"}
_AT, _DOT = r"\x20?+[\[({<]\x20?+(?i:at)\x20?+[\])}>]\x20?+", r"\x20?+[\[({<]\x20?+(?i:dot)\x20?+[\])}>]\x20?+"
#: Wider patterns that propose candidates: marked @ and dots, dotted numbers of any length, digits
#: with any single or double separators, long strings with letters and digits.
WIDE = {
    "email": rf"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++(?:@|{_AT})[A-Za-z0-9-]++(?:(?:\.|{_DOT})[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]++(?:\[?+\.\]?+[0-9]++){2,}+",
    "card": r"(?<![0-9])(?:[0-9]{14,19}+(?![0-9])|[0-9](?:[\x20./_-]{0,2}+[0-9]){13,18}+(?![\x20./_-]{0,2}[0-9]))",
    "phone": r"(?<![0-9+])(?<![0-9][\x20./_-])(?:\([0-9]{2,4}\)[\x20.-]?+)?+[0-9](?:[\x20./_-]?+[0-9]){6,12}+(?![\x20./_-]?[0-9])",
    "secret": r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])(?=[0-9_+/-]*+[A-Za-z])[A-Za-z0-9_+/-]{16,}+",
}
#: Words near a span that speak for its kind.
CUES = {
    "email": "mail|contact|write", "ip": r"\bip\b|host|addr|server", "card": "card|visa|credit|amex|debit|payment",
    "phone": "phone|tel|call|fax|mobile|cell", "secret": "token|secret|passw|pwd|api|auth|key",
}
FEATURES = ("kind_no", "size", "digits", "letters", "marks", "groups", "longest", "luhn", "octets", "hex", "turns", "brackets", "ending", "cue", "assigned")
#: Features that are 0 for all kinds but one.
ONLY = {"luhn": "card", "octets": "ip", "ending": "email", "brackets": "email", "hex": "secret", "turns": "secret"}
#: Code points of the text kept on either side of a candidate.
CONTEXT = 24
#: Bounds of the sample that the trees are fitted on: documents that are looked into, and examples.
SAMPLE_DOCS, SAMPLE_ROWS = 20_000, 40_000
_SPAN = "struct<kind:string,start:bigint,end:bigint,hit:string,before:string,after:string>"
_RUN = 64


def _luhn(text: Column) -> Column:
    """Whether the digits of a string pass the Luhn sum."""
    digits = F.filter(F.split(F.reverse(text), ""), lambda c: c.between("0", "9"))
    worth = F.transform(digits, lambda c, i: F.when(i % 2 == 1, 2 * c.cast("int") - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(worth, F.lit(0), lambda a, x: a + x) % 10 == 0


def _digits(text: Column) -> Column:
    return F.char_length(F.regexp_replace(text, "[^0-9]", ""))


#: What a base match has to fulfil besides its pattern.
HOLDS: dict[str, Callable[[Column], Column]] = {
    "email": lambda hit: F.lit(True),
    "ip": lambda hit: hit.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$"),
    "card": _luhn,
    "phone": lambda hit: _digits(hit).between(10, 15),
}


def _barrier(df: DataFrame, *columns: Column) -> DataFrame:
    """Compute the columns once, whatever is made of them later."""
    return df.select(F.inline(F.array(F.struct(*columns))))


def _sweep(items: str, out: str, state: str, begin: Column, step: Callable, last: Callable | None = None) -> Column:
    """One pass over an array column in order: ``step(state, item)`` gives the next state, an output of type ``out`` and whether it is kept.

    ``last(state)`` gives an output and whether it is kept at the end. A fold copies what it has
    gathered at each step, so items are taken in runs: each is folded by itself, and its
    outputs are set aside as one.
    """
    none = F.array().cast(f"array<{out}>")
    runs = F.when(F.size(items) > 0, F.transform(F.sequence(F.lit(0), F.expr(f"cast((size({items}) - 1) div {_RUN} AS int)")), lambda i: F.slice(items, i * _RUN + 1, F.lit(_RUN)))).otherwise(F.array())

    def one(acc: Column, x: Column) -> Column:
        after, made, kept = step(acc["state"], x)
        return F.struct(after.cast(state).alias("state"), F.when(kept, F.array_append(acc["made"], made.cast(out))).otherwise(acc["made"]).alias("made"))

    def run(acc: Column, some: Column) -> Column:
        fresh = F.struct(acc["state"].alias("state"), none.alias("made"))
        return F.aggregate(some, fresh, one, lambda r: F.struct(r["state"].alias("state"), F.array_append(acc["out"], r["made"]).alias("out")))

    def end(acc: Column) -> Column:
        if last is None:
            return F.flatten(acc["out"])
        made, kept = last(acc["state"])
        return F.flatten(F.when(kept, F.array_append(acc["out"], F.array(made.cast(out)))).otherwise(acc["out"]))

    return F.aggregate(runs, F.struct(begin.cast(state).alias("state"), F.array().cast(f"array<array<{out}>>").alias("out")), run, end)


def _pieces(text: str, patterns: dict[str, str], tag: str) -> list[Column]:
    """Gaps between the matches of each pattern, and the matches; both empty where the hint is absent."""
    out = []
    for kind, p in patterns.items():
        there = F.col(text).rlike(WIDE_HINT.get(kind, HINT[kind]) if tag == "wide" else HINT[kind])
        none = F.array().cast("array<string>")
        out += [F.when(there, F.split(text, p, -1)).otherwise(none).alias(f"{tag}_{kind}_gaps"), F.when(there, F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none).alias(f"{tag}_{kind}_hits")]
    return out


def _parts(kind: str, tag: str) -> Column:
    """Each gap with the match behind it and the next gap."""
    gaps, hits = F.col(f"{tag}_{kind}_gaps"), F.col(f"{tag}_{kind}_hits")
    pairs = F.zip_with(gaps, hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    near = F.transform(F.slice(gaps, 2, F.greatest(F.size(gaps), F.lit(1))), lambda g: F.left(g, F.lit(CONTEXT)))
    return F.zip_with(pairs, near, lambda p, g: F.struct(p["gap"].alias("gap"), p["hit"].alias("hit"), g.alias("next"))).alias(f"{tag}_{kind}")


def _spans(kind: str, tag: str, holds: Callable[[Column], Column]) -> Column:
    """The matches that hold, with their places in code points and the text around them."""

    def step(at: Column, p: Column) -> tuple[Column, Column, Column]:
        begin = at + F.char_length(p["gap"])
        end = begin + F.coalesce(F.char_length(p["hit"]), F.lit(0))
        span = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"), p["hit"].alias("hit"), F.right(p["gap"], F.lit(CONTEXT)).alias("before"), F.coalesce(p["next"], F.lit("")).alias("after"))
        return end, span, p["hit"].isNotNull() & holds(p["hit"])

    return _sweep(f"{tag}_{kind}", _SPAN, "bigint", F.lit(0), step)


def proposals(docs: DataFrame) -> DataFrame:
    """doc_id, the base spans and the candidates of the wider patterns, both as arrays of spans."""
    rows = _barrier(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), F.col("doc_id"), *_pieces("text", BASE, "base"), *_pieces("text", WIDE, "wide"))
    rows = _barrier(rows, F.col("doc_id"), *(_parts(k, "base") for k in BASE), *(_parts(k, "wide") for k in WIDE))
    base = F.concat(*(_spans(k, "base", HOLDS[k]) for k in BASE))
    wide = F.concat(*(_spans(k, "wide", (lambda hit: _digits(hit) >= 7) if k == "phone" else lambda hit: F.lit(True)) for k in WIDE))
    return _barrier(rows, F.col("doc_id"), base.alias("base"), wide.alias("wide"))


def _features(x: Column) -> Column:
    """A span with its features, all doubles."""
    hit, kind = x["hit"], x["kind"]
    groups = F.regexp_extract_all(hit, F.lit("[0-9]+"), F.lit(0))
    near = F.lower(F.concat(x["before"], F.lit(" "), x["after"]))
    cue, number = F.lit(False), F.lit(0)
    for i, k in enumerate(KINDS):
        cue, number = F.when(kind == k, near.rlike(CUES[k])).otherwise(cue), F.when(kind == k, i).otherwise(number)
    small = F.forall(groups, lambda g: (F.char_length(g) <= 3) & (g.cast("int") <= 255))
    values = {
        "kind_no": number, "size": F.char_length(hit), "digits": _digits(hit), "letters": F.char_length(F.regexp_replace(hit, "[^A-Za-z]", "")),
        "marks": F.char_length(F.regexp_replace(hit, "[A-Za-z0-9]", "")), "groups": F.size(groups),
        "longest": F.aggregate(groups, F.lit(0), lambda a, g: F.greatest(a, F.char_length(g))),
        "luhn": _luhn(hit), "octets": small & (F.size(groups) == 4), "hex": ~hit.rlike("[G-Zg-z]"),
        "turns": F.size(F.regexp_extract_all(hit, F.lit("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])"), F.lit(0))),
        "brackets": hit.rlike(r"[\[({<]"), "ending": F.char_length(F.regexp_extract(hit, r"([A-Za-z]+)$", 1)), "cue": cue,
        "assigned": x["before"].rlike("[=:]\\s*[\"']?$"),
    }
    for f, k in ONLY.items():  # a feature that means nothing for other kinds must not tell them apart
        values[f] = F.when(kind == k, values[f].cast("double"))
    return F.struct(*(x[c].alias(c) for c in ("kind", "start", "end")), *(F.coalesce(values[f].cast("double"), F.lit(0.0)).alias(f) for f in FEATURES))


def _rewritten() -> Column:
    """What a span teaches: itself and other spellings of it with their label; null where it teaches nothing."""
    s = F.col("s")
    kind, hit, truth = s["kind"], s["hit"], F.col("truth")
    bare = F.regexp_replace(hit, "[^0-9]", "")

    def like(text: Column, label: int | Column, before: Column = s["before"]) -> Column:
        span = F.struct(kind.alias("kind"), s["start"].alias("start"), s["end"].alias("end"), text.alias("hit"), before.alias("before"), s["after"].alias("after"))
        return F.struct(span.alias("s"), (F.lit(label) if isinstance(label, int) else label).cast("double").alias("label"))

    marked = F.regexp_replace(F.regexp_replace(hit, "@", " [at] "), r"\.(?=[A-Za-z0-9-]+$)", " [dot] ")
    spaced = F.regexp_replace(bare, "([0-9]{4})(?=[0-9])", "$1.")
    last = F.concat(F.expr("left(regexp_replace(s.hit, '[^0-9]', ''), length(regexp_replace(s.hit, '[^0-9]', '')) - 1)"), ((F.right(bare, F.lit(1)).cast("int") + 1) % 10).cast("string"))
    local = F.regexp_replace(hit, r"^\+[0-9]{1,3}[\x20.-]*", "")
    dashed = F.regexp_replace(F.right(bare, F.lit(10)), "^([0-9]{3})([0-9]{3})([0-9]{4})$", "$1-$2-$3")
    cut = F.expr("16 + cast(pmod(xxhash64(s.hit), 25) AS int)")  # of any length, so that length alone tells nothing
    letters = F.left(F.translate(hit, "0123456789", "ghijklmnop"), cut)
    worded = F.concat(F.regexp_replace(letters, "([a-z]{1,5})", "$1-"), F.lit("1"))
    return (
        F.when(truth & (kind == "email"), F.array(like(hit, 1), like(marked, 1), like(F.regexp_replace(hit, "[A-Za-z]+$", "7"), 0)))
        .when(truth & (kind == "ip"), F.array(like(hit, 1), like(F.regexp_replace(hit, r"\.", "[.]"), 1), like(F.regexp_replace(hit, r"\.[0-9]+$", ""), 0), like(F.concat(hit, F.lit(".7")), 0), like(F.concat(F.lit("9"), F.lpad(hit, F.char_length(hit) + 2, "9")), 0)))
        .when(truth & (kind == "card"), F.array(like(hit, 1), like(spaced, 1), like(last, 0)))
        .when(truth & (kind == "phone"), F.array(like(local, 1), like(dashed, 1), like(F.right(bare, F.lit(8)), 0), like(F.concat(bare, F.lit("1")), 0), like(F.regexp_replace(dashed, "-", "."), 1)))
        .when(kind == "secret", F.when(truth, F.array(like(hit, 1), like(hit, 1, F.lit("")), like(F.left(hit, F.greatest(cut, F.lit(20))), 1, F.lit("")), like(F.concat(letters, F.lit("7")), 0, F.lit("")), like(worded, 0, F.lit("")), like(F.concat(F.lit("1-"), F.regexp_replace(worded, "-1$", "")), 0, F.lit("")))))
        .when(kind == "card", F.array(like(hit, _luhn(hit).cast("int"))))
    )


def examples(found: DataFrame, docs: int = SAMPLE_DOCS, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Labelled features of at most ``rows`` spans from at most ``docs`` documents, chosen by hash.

    Labels come from the rules and not from people: base spans are personal data, and so are
    long strings that a word such as token or password assigns; other spellings of them keep the
    label, broken ones (a wrong check digit, five numbers, letters and hyphens) lose it. Half of the
    documents, by hash, is held out to set thresholds.
    """
    sample = found.where(F.size("base") + F.size("wide") > 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(docs)
    secret = F.filter("wide", lambda x: (x["kind"] == "secret") & F.lower(x["before"]).rlike(CUES["secret"]) & x["before"].rlike("[=:]\\s*[\"']?$"))
    doubt = F.filter("wide", lambda x: x["kind"] == "card")
    sure = sample.select("doc_id", F.explode(F.concat("base", secret)).alias("s")).withColumn("truth", F.lit(True))
    rest = sample.select("doc_id", F.explode(doubt).alias("s")).withColumn("truth", F.lit(False))
    each = sure.unionByName(rest).select("doc_id", F.explode(_rewritten()).alias("x"))
    tidy = each.select("doc_id", F.col("x.label").alias("label"), _features(F.col("x.s")).alias("f")).select("doc_id", "label", "f.*")
    return tidy.orderBy(F.xxhash64("doc_id", "start"), *FEATURES, "label").limit(rows).withColumn("held", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)) == 1)


def _case(node, x: str) -> str:
    """A tree of the fitted model as nested CASE expressions over the fields of ``x``."""
    if node.numDescendants() == 0:
        return repr(float(node.prediction()))
    split = node.split()
    return f"CASE WHEN {x}.{FEATURES[split.featureIndex()]} <= {float(split.threshold())!r}D THEN {_case(node.leftChild(), x)} ELSE {_case(node.rightChild(), x)} END"


def fit(sample: DataFrame, *, trees: int = 15, depth: int = 4, precision: float = 0.97) -> tuple[str, dict[str, float]]:
    """The score of a span ``x`` as SQL, and each kind's threshold.

    The score is the boosted margin as a probability. A kind's threshold is the lowest hundredth
    from one half on, from which up its held-out examples reach ``precision``; a kind without
    such a place, or an empty sample or one of a single label, gets 2, which nothing reaches.
    """
    never = dict.fromkeys(KINDS, 2.0)
    if sample.where("not held").select("label").distinct().count() < 2:
        return "0.0D", never
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="vector")
    model = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=7).fit(vectors.transform(sample.where("not held").coalesce(1)))
    sums = " + ".join(f"{float(w)!r}D * ({_case(t._java_obj.rootNode(), 'x')})" for t, w in zip(model.trees, model.treeWeights, strict=True))
    score = f"1 / (1 + exp(-2 * ({sums})))"
    held = sample.where("held").select(F.struct(*FEATURES).alias("x"), "label").select("x.kind_no", F.expr(f"floor(100 * ({score}))").cast("int").alias("bin"), "label")
    bins: dict[int, dict[int, tuple[float, int]]] = {}
    for r in held.groupBy("kind_no", "bin").agg(F.sum("label").alias("true"), F.count("*").alias("n")).collect():  # five kinds, 101 bins
        bins.setdefault(int(r.kind_no), {})[r.bin] = (r.true, r.n)
    for i, k in enumerate(KINDS):
        true = n = 0
        for b in sorted((b for b in bins.get(i, {}) if b >= 50), reverse=True):
            true, n = true + bins[i][b][0], n + bins[i][b][1]
            if true < precision * n:
                never[k] = never[k] if never[k] > 1 else (b + 1) / 100
                break
            never[k] = 0.5
    return score, never


def _resolve(spans: str) -> Column:
    """Of candidates sorted by start, those that stay: a base span beats all, of two others the higher score, then the earlier."""

    def step(held: Column, x: Column) -> tuple[Column, Column, Column]:
        apart = held.isNull() | (x["start"] >= held["end"])
        wins = (x["score"] > held["score"]) | ((x["score"] > 1) & (x["end"] > held["end"]))
        return F.when(apart | wins, x).otherwise(held), held, apart & (held["score"] <= 1)

    kind = "struct<start:bigint,kind_no:double,end:bigint,kind:string,score:double>"
    return _sweep(spans, kind, kind, F.lit(None), step, lambda held: (held, held["score"] <= 1))


def find(docs: DataFrame) -> DataFrame:
    """The base spans of each text, and those that the trees add.

    Returns doc_id, ``base`` and ``added``: arrays of structs (kind, start, end) in code points,
    end exclusive, by start, then kind. The base rules find e-mail addresses, IPv4 addresses,
    card numbers and telephone numbers; the trees add other spellings of these, and secrets (long
    strings as in a token or password). A candidate that overlaps a base span is not added; of
    two that overlap, the one with the higher score is. The model is fitted on at most
    ``SAMPLE_DOCS`` documents and ``SAMPLE_ROWS`` examples chosen by hash; everything else takes
    all rows and whole texts. No Python runs in tasks.

    Null and empty texts have no spans. Null doc_ids stay null, repeated rows are searched
    each, and other columns of ``docs`` are ignored. An empty table gives no rows. A span is
    found wherever it is in a text of any length; a text is one row.
    """
    batch_rows(docs.sparkSession)
    found = proposals(docs)
    sample = materialize(examples(found).coalesce(1), "pii")
    score, thresholds = fit(sample)
    limit = F.lit(2.0)
    for k, t in thresholds.items():
        limit = F.when(F.col("x.kind") == k, t).otherwise(limit)
    flat = lambda x, s, number=None: F.struct(x["start"].alias("start"), (x["kind_no"] if number is None else number).cast("double").alias("kind_no"), x["end"].alias("end"), x["kind"].alias("kind"), s.alias("score"))
    number = lambda x: F.array_position(F.array(*map(F.lit, KINDS)), x["kind"]) - 1
    base = F.array_sort(F.transform("base", lambda x: flat(x, F.lit(2.0), number(x))))
    chosen = f"filter(transform(featured, x -> named_struct('start', x.start, 'kind_no', x.kind_no, 'end', x.end, 'kind', x.kind, 'score', {score})), x -> x.score >= " + " ".join(["CASE x.kind", *(f"WHEN '{k}' THEN {t!r}D" for k, t in thresholds.items()), "ELSE 2.0D END)"])
    rows = _barrier(found, F.col("doc_id"), base.alias("base"), F.transform("wide", _features).alias("featured"))
    rows = _barrier(rows, F.col("doc_id"), F.col("base"), F.expr(chosen).alias("chosen"))
    rows = _barrier(rows, F.col("doc_id"), F.col("base"), F.array_sort(F.concat("base", "chosen")).alias("all"))
    rows = _barrier(rows, F.col("doc_id"), F.col("base"), _resolve("all").alias("added"))
    bare = lambda c: F.transform(c, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["kind_no"].alias("kind_no"))).alias(c)
    return rows.select("doc_id", bare("base"), bare("added"))


def redact(docs: DataFrame) -> DataFrame:
    """doc_id and the text of each span of :func:`find`, a row a span: kind, start, end, whether the base rules found it."""
    each = lambda c, base: F.transform(c, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.lit(base).alias("base")))
    return find(docs).select("doc_id", F.explode(F.concat(each("base", True), each("added", False))).alias("x")).select("doc_id", "x.*")


def digest(found: DataFrame) -> DataFrame:
    """Counts and a hash of the base spans, and all spans as text ``kind:start:end,...``."""
    told = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    ordered = F.array_sort(F.transform(F.concat("base", "added"), lambda x: F.struct(x["start"].alias("start"), x["kind_no"].alias("kind_no"), x["end"].alias("end"), x["kind"].alias("kind"))))
    of = lambda kind: lambda x: x["kind"] == kind
    counts = (F.size(F.filter("base", of(k))).cast("long").alias(f"n_{k}") for k in BASE)
    return found.select("doc_id", *counts, F.sha2(told(F.col("base")), 256).alias("base_sha256"), told(ordered).alias("spans"))
