"""Personal data by weak supervision, in DataFrame and SQL functions only.

Base spans come from four patterns with checks (an address, at most 255 in each part; Luhn; digit counts). Further
candidates come from wider patterns. Four labelers vote on every candidate (yes, no or abstain): strict patterns, a
gazetteer of endings and prefixes, words in front of it, and what it touches. `candidates` stores all of them once;
`fit` counts the votes by kind, estimates each labeler's reliability and each vote pattern's posterior by
expectation-maximisation (a fold over the table of vote patterns, at most 3^4 for each kind), and trains the span
classifier on shape features with these posteriors as soft labels. `detect` keeps every base span and adds the candidates that the classifier
takes and that overlap no base span.

Positions are code points, end exclusive. Null texts count as empty and have no spans; repeated rows are treated
alike; an empty table gives no rows and no weights; other columns pass through, whatever their names. Matches of 5
characters or less, or of 400 or more, are no candidates for further spans; base spans know no such limit. Places are
summed in chunks and overlaps found by bisection, so a text's cost grows with its length alone. The patterns are written with possessive quantifiers and starts that cannot lie
inside a run, which gives the same leftmost matches in linear time on very long texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

KINDS = ("email", "ip", "card", "phone")
_LOCAL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++"
BASE = {
    "email": _LOCAL + r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-](?:[ ().-]*+[0-9])++",
}
WIDE = {
    "email": _LOCAL + r"(?: ?[\[(]at[\])] ?| at )[A-Za-z0-9-]++(?:(?: ?[\[(]dot[\])] ?| dot |\.)[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9+])(?:\([0-9]{2,4}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
#: Texts without these hold no match, which spares most of them the patterns.
_NEEDS = {"email": "contains(text, '@')", "ip": "text rlike '[0-9]'", "card": "text rlike '[0-9]'", "phone": "contains(text, '+')"}
_WIDE_NEEDS = {"email": r"text rlike r'[\[(]at[\])]| at [A-Za-z0-9-]+(?: ?[\[(]dot[\])]| dot |\.)'", "phone": "text rlike '[0-9]'"}
#: Gazetteers: endings of mail domains, issuers' first digits, calling codes.
ENDINGS = "com|org|net|edu|gov|io|co|info|biz|uk|de|fr|es|eu|us|ch|at|it|nl|example|test"
ISSUERS = "4|5[1-5]|2[2-7]|3[47]|6011|65|35|30|36|38"
CALLING = "1|7|20|27|3[0-469]|4[0-13-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
WORDS = {
    "email": "mail|contact|write to|reach",
    "ip": "\\bip\\b|server|host|address|from",
    "card": "card|visa|credit|debit|pay|amex",
    "phone": "phone|tel|call|mobile|fax|cell|ring",
}
NOT_WORDS = "version|isbn|order|invoice|page|chapter|section|serial|build"
#: A match, its place, up to 32 characters in front of it and the one behind it.
SPAN = "array<struct<m string, s int, e int, b string, n string>>"
ROUNDS = 25
#: Log odds that a further span needs.
THRESHOLD = 1.0
_LABELERS = 4


def _sum(array: str) -> str:
    return f"aggregate({array}, 0, (a, x) -> a + x)"


def _with_places(df: DataFrame, k: str, out: str) -> DataFrame:
    """Adds SPAN column `out`: the matches in f_<k> with their places, from the pieces between them in p_<k>.

    Lengths are summed in chunks of 64, so that long lists need no sum over all that precedes for each match.
    """
    df = df.withColumn(f"l_{k}", F.expr(f"transform(f_{k}, (m, i) -> length(element_at(p_{k}, i + 1)) + length(m))"))
    df = df.withColumn(f"c_{k}", F.expr(f"CASE WHEN size(l_{k}) > 0 THEN transform(sequence(0, int((size(l_{k}) - 1) div 64)), c -> slice(l_{k}, 64 * c + 1, 64)) END"))
    df = df.withColumn(f"h_{k}", F.expr(f"transform(c_{k}, c -> {_sum('c')})"))
    df = df.withColumn(f"g_{k}", F.expr(f"transform(h_{k}, (s, c) -> {_sum(f'slice(h_{k}, 1, c)')})"))
    start = f"element_at(g_{k}, int(i div 64) + 1) + {_sum(f'slice(element_at(c_{k}, int(i div 64) + 1), 1, i % 64)')} + length(element_at(p_{k}, i + 1))"
    placed = f"transform(f_{k}, (m, i) -> named_struct('m', m, 's', int({start}), 'i', i))"
    full = f"transform({placed}, x -> named_struct('m', x.m, 's', x.s, 'e', x.s + length(x.m), 'b', lower(right(element_at(p_{k}, x.i + 1), 32)), 'n', left(element_at(p_{k}, x.i + 2), 1)))"
    # a second mention of g_<k> keeps the optimiser from putting the sums inside the function of each match
    return df.withColumn(out, F.expr(f"CASE WHEN size(f_{k}) > 0 AND size(g_{k}) > 0 THEN {full} ELSE cast(array() as {SPAN}) END")).drop(f"f_{k}", f"p_{k}", f"l_{k}", f"c_{k}", f"h_{k}", f"g_{k}")


_DIGITS = "translate(x.m, '+ ().-', '')"
_LUHN = f"aggregate(sequence(1, length({_DIGITS})), 0, (a, i) -> a + if((length({_DIGITS}) - i) % 2 = 1, if(2 * int(substr({_DIGITS}, i, 1)) > 9, 2 * int(substr({_DIGITS}, i, 1)) - 9, 2 * int(substr({_DIGITS}, i, 1))), int(substr({_DIGITS}, i, 1)))) % 10 = 0"
_PART = r"^0*+(?:|[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"
CHECKS = {
    "email": "true",
    "ip": f"forall(split(x.m, r'\\.'), p -> p rlike r'{_PART}')",
    "card": f"length({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN}",
    "phone": f"length({_DIGITS}) BETWEEN 9 AND 15",
}


def with_base(docs: DataFrame) -> DataFrame:
    """docs with text never null, all_<kind> (matches) and base_<kind> (those that pass the check)."""
    out, names = docs.withColumn("text", F.coalesce("text", F.lit(""))), [c for c in docs.columns if c != "text"]
    patterns = [(k, BASE[k], _NEEDS[k]) for k in KINDS] + [(f"wide_{k}", WIDE[k], _WIDE_NEEDS[k]) for k in WIDE]
    found = [F.expr(f"CASE WHEN {needs} THEN regexp_extract_all(text, r'{p}', 0) ELSE cast(array() as array<string>) END").alias(f"f_{k}") for k, p, needs in patterns]
    out = out.select(*names, "text", *found)
    out = out.select("*", *(F.expr(f"CASE WHEN size(f_{k}) > 0 THEN split(text, r'{p}', -1) END").alias(f"p_{k}") for k, p, _ in patterns))
    for k, _, _ in patterns:
        out = _with_places(out, k, k if k.startswith("wide") else f"all_{k}")
    return out.select("*", *(F.expr(f"filter(all_{k}, x -> {CHECKS[k]})").alias(f"base_{k}") for k in KINDS))


_STRICT = {
    "email": r"CASE WHEN x.m rlike r'^[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9][A-Za-z0-9-]{0,62}\.)+[A-Za-z]{2,24}$' THEN 1 WHEN contains(x.m, '@') THEN -1 ELSE 0 END",
    "ip": f"if({CHECKS['ip']}, 1, -1)",
    "card": f"if({CHECKS['card']}, 1, -1)",
    "phone": f"CASE WHEN startswith(x.m, '+') THEN if({CHECKS['phone']}, 1, -1) WHEN length({_DIGITS}) = 10 THEN 0 ELSE -1 END",
}
_LISTED = {
    "email": f"if(lower(x.m) rlike r'(?:\\.|dot[\\])]? ?)(?:{ENDINGS})$', 1, -1)",
    "ip": "if(x.m rlike r'^(?:[1-9][0-9]?|1[0-9]{2}|2[01][0-9]|22[0-3])\\.', 1, -1)",
    "card": f"if({_DIGITS} rlike r'^(?:{ISSUERS})', 1, -1)",
    "phone": f"CASE WHEN NOT startswith(x.m, '+') THEN 0 WHEN {_DIGITS} rlike r'^(?:{CALLING})' THEN 1 ELSE -1 END",
}


def with_candidates(based: DataFrame) -> DataFrame:
    """based with cands: kind, s, e, base (whether it is a base span), votes (of -1, 0, 1) and feats (buckets) of every match, base or not."""
    before, after = "x.b", "x.n"
    parts = []
    for k in KINDS:
        votes = f"array({_STRICT[k]}, {_LISTED[k]}, CASE WHEN {before} rlike r'{NOT_WORDS}' THEN -1 WHEN {before} rlike r'{WORDS[k]}' THEN 1 ELSE 0 END, if({before} rlike r'[a-z0-9._-]$' OR {after} rlike r'[A-Za-z0-9]', -1, 1))"
        shape = "CASE WHEN x.m rlike r'^[0-9]+$' THEN 'digits' WHEN contains(x.m, '@') THEN 'at' WHEN startswith(x.m, '+') THEN 'plus' WHEN x.m rlike r'[A-Za-z]' THEN 'letters' WHEN contains(x.m, '.') THEN 'dots' ELSE 'parted' END"
        feats = f"array({shape}, string(least(length(x.m) div 4, 8)), string(least(length({_DIGITS}), 20) div 2), if({before} rlike r'[:=(<\"] ?$', 'marked', 'plain'))"
        source = f"concat(all_{k}, wide_{k})" if k in WIDE else f"all_{k}"
        check = "contains(x.m, '@')" if k == "email" else f"startswith(x.m, '+') AND {CHECKS[k]}" if k == "phone" else CHECKS[k]
        parts.append(f"transform(filter({source}, x -> x.e - x.s < 400 AND x.e - x.s > 5), x -> named_struct('kind', '{k}', 's', x.s, 'e', x.e, 'base', {check}, 'votes', {votes}, 'feats', {feats}))")
    return based.withColumn("cands", F.expr(f"concat({', '.join(parts)})"))


def candidates(docs: DataFrame, *names: str) -> DataFrame:
    """Stored: the named columns of docs, base_<kind> and cands of every row. Behind this boundary the patterns are not run again."""
    found = with_candidates(with_base(docs.select(*names, *(() if "text" in names else ("text",)))))
    return stored(found.select(*(c for c in names if c != "text"), *(f"base_{k}" for k in KINDS), "cands"), "pii-candidates")


def fit(found: DataFrame) -> dict[str, float]:
    """Weights of the span classifier from stored cands, by 'kind|feature|value' and 'kind|prior'. Bounded by the feature buckets."""
    cells = found.select(F.explode("cands").alias("c")).groupBy("c.kind", "c.votes", "c.feats").agg(F.count("*").cast("double").alias("n"))
    cells = stored(cells, "pii-cells")
    patterns = cells.groupBy("kind", "votes").agg(F.sum("n").alias("n")).groupBy("kind").agg(F.collect_list(F.struct("votes", "n")).alias("cells"))
    size, places = 3 * _LABELERS, range(_LABELERS)
    like = lambda t: " * ".join(f"element_at(st.{t}, {3 * j + 2} + c.votes[{j}])" for j in places)
    post = f"(st.pi * {like('p')} / (st.pi * {like('p')} + (1 - st.pi) * {like('q')}))"
    total = lambda w: f"aggregate(r, 0D, (a, c) -> a + {w})"
    table = lambda w: f"transform(sequence(0, {size - 1}), k -> ({total(f'if(c.votes[int(k div 3)] + 1 = k % 3, {w}, 0D)')} + 0.5D) / ({total(w)} + 1.5D))"
    vague = lambda *x: f"transform(sequence(0, {size - 1}), k -> element_at(array({', '.join(f'{y}D' for y in x)}), k % 3 + 1))"
    start = f"named_struct('pi', 0.5D, 'p', {vague(0.1, 0.3, 0.6)}, 'q', {vague(0.6, 0.3, 0.1)})"
    expected = f"transform(cells, c -> named_struct('votes', c.votes, 'n', c.n, 'y', c.n * {post}))"
    maximised = f"named_struct('pi', ({total('c.y')} + 1D) / ({total('c.n')} + 2D), 'p', {table('c.y')}, 'q', {table('c.n - c.y')})"
    model = f"aggregate(sequence(1, {ROUNDS}), {start}, (st, i) -> element_at(transform(array({expected}), r -> {maximised}), 1))"
    fitted = patterns.withColumn("st", F.expr(model)).select("kind", F.explode(F.expr(f"transform(cells, c -> named_struct('votes', c.votes, 'r', {post}))")).alias("x")).select("kind", "x.votes", "x.r")
    soft = cells.join(fitted, ["kind", "votes"]).withColumn("feats", F.concat(F.col("feats"), F.array(F.lit("prior"))))
    weights = soft.select("kind", F.posexplode("feats").alias("j", "value"), (F.col("n") * F.col("r")).alias("yes"), (F.col("n") * (1 - F.col("r"))).alias("no")).groupBy("kind", "j", "value").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    prior = weights.where("value = 'prior'").select("kind", F.log((F.col("yes") + 1) / (F.col("no") + 1)).alias("prior"))
    rows = weights.join(F.broadcast(prior), "kind").select("kind", "j", "value", F.log((F.col("yes") + 1) / (F.col("no") + 1)).alias("w"), "prior").collect()
    return {f"{r.kind}|prior": r.prior for r in rows if r.value == "prior"} | {f"{r.kind}|{r.j}|{r.value}": r.w - r.prior for r in rows if r.value != "prior"}


#: Code points in a chunk of a text that is masked.
_CHUNK = 1024
_STEPS = ", ".join(str(1 << k) for k in range(27, -1, -1))


def _below(array: str, than: str) -> str:
    """How many numbers of an ascending array meet `than` (a condition on one, from the first on), by bisection."""
    return f"aggregate(array({_STEPS}), 0, (a, w) -> if(coalesce(get({array}, a + w - 1) {than}, false), a + w, a))"


def detect(found: DataFrame, weights: dict[str, float]) -> DataFrame:
    """found (base_<kind> and cands) with base and spans: kind number, start, end of base spans and of those that the classifier adds, in order."""
    base = "concat(" + ", ".join(f"transform(base_{k}, x -> named_struct('k', {i}, 's', x.s, 'e', x.e))" for i, k in enumerate(KINDS)) + ")"
    out = found.withColumn("base", F.expr(base))
    none = F.expr("cast(array() as array<struct<k int, s int, e int>>)")
    if not weights:
        return out.withColumn("spans", F.array_sort("base"))
    keys, values = ", ".join(f"'{k}'" for k in weights), ", ".join(f"{v!r}D" for v in weights.values())
    score = "aggregate(transform(c.feats, (f, j) -> w[concat(c.kind, '|', j, '|', f)]), coalesce(w[concat(c.kind, '|prior')], -1D), (a, x) -> a + coalesce(x, 0D))"
    number = "CASE c.kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(KINDS)) + " END"
    out = out.withColumn("w", F.expr(f"map_from_arrays(array({keys}), array({values}))"))
    out = out.withColumn("starts", F.expr("array_sort(transform(base, x -> x.s))")).withColumn("ends", F.expr("array_sort(transform(base, x -> x.e))"))
    # no base span overlaps a candidate if as many end up to its start as start before its end
    free = f"(size(starts) = 0 OR size(ends) = 0 OR {_below('starts', '< c.e')} = {_below('ends', '<= c.s')})"
    more = f"transform(filter(cands, c -> NOT c.base AND {score} >= {THRESHOLD}D AND {free}), c -> named_struct('k', {number}, 's', c.s, 'e', c.e))"
    out = out.withColumn("more", F.when(F.exists("cands", lambda c: ~c.base), F.expr(more)).otherwise(none))
    return out.withColumn("spans", F.array_sort(F.concat("base", "more"))).drop("w", "starts", "ends", "more")


def _joined(spans: str) -> str:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform({spans}, x -> concat_ws(':', element_at(array({names}), x.k + 1), x.s, x.e)), ',')"


def personal_data(docs: DataFrame) -> DataFrame:
    rows = candidates(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", "text")
    found = detect(rows, fit(rows))
    return found.select("doc_id", *(F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(F.expr(_joined("array_sort(base)")), 256).alias("base_sha256"), F.expr(_joined("spans")).alias("spans"))


def redact(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """docs with every span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    names, others = docs.columns, [c for c in docs.columns if c != text]
    rows = docs.select(F.struct(F.col(text).isNull().alias("none"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others))).alias("row"), F.col(text).alias("text"))
    # rows travel with their candidates: the patterns run once, and no task holds the garbage of matching beside that of masking
    rows = stored(with_candidates(with_base(rows)).select("row", "text", *(f"base_{k}" for k in KINDS), "cands"), "pii-candidates")
    found = detect(rows, fit(rows)).select("row", "text", "spans")
    found = found.withColumn("starts", F.expr("array_sort(transform(spans, x -> x.s))")).withColumn("ends", F.expr("array_sort(transform(spans, x -> x.e))"))
    # the text in chunks of 1024, so that a piece costs no walk from the beginning
    found = found.withColumn("parts", F.expr(f"CASE WHEN size(spans) > 0 THEN transform(sequence(0, length(text) div {32 * _CHUNK}), i -> substring(text, i * {32 * _CHUNK} + 1, {32 * _CHUNK})) END"))
    found = found.withColumn("chunks", F.expr(f"flatten(transform(parts, p -> transform(sequence(0, 31), i -> substring(p, i * {_CHUNK} + 1, {_CHUNK}))))")).drop("parts")
    # a span heads a group of overlapping ones if all that start before it have ended
    order = "array_sort(transform(spans, x -> named_struct('s', x.s, 'e', x.e, 'k', x.k)))"
    found = found.withColumn("order", F.expr(order))
    found = found.withColumn("heads", F.expr(f"filter(transform(order, (x, i) -> named_struct('s', x.s, 'k', x.k, 'n', {_below('starts', '< x.s')}, 'first', coalesce(get(order, i - 1).s <> x.s, true))), x -> x.first AND x.n = {_below('ends', '<= x.s')} AND size(ends) > 0 AND size(starts) > 0)"))
    piece = lambda a, z: f"substring(array_join(slice(chunks, int({a} div {_CHUNK}) + 1, int({z} div {_CHUNK}) - int({a} div {_CHUNK}) + 1), ''), {a} % {_CHUNK} + 1, {z} - {a})"
    labels = ", ".join(f"'[{k.upper()}]'" for k in KINDS)
    before = "if(h.n = 0, 0, get(ends, h.n - 1))"
    body = f"array_join(transform(heads, h -> concat({piece(before, 'h.s')}, element_at(array({labels}), h.k + 1))), '')"
    masked = f"concat({body}, {piece('element_at(ends, -1)', 'length(text)')})"
    clean = found.withColumn("clean", F.when(F.expr("size(heads) > 0 AND size(chunks) > 0 AND size(ends) > 0"), F.expr(masked)).when(~F.col("row.none"), F.col("text")))
    put = {text: F.col("clean")} | ({n_chars: F.length("clean").cast(docs.schema[n_chars].dataType)} if n_chars in names else {})
    return clean.select(*(put[c].alias(c) if c in put else F.col(f"row.c{others.index(c)}").alias(c) for c in names))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
