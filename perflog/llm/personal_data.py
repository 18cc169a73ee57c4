"""Personal data by regular expressions and weak supervision (operator 8), in DataFrame functions only.

Base kinds (email, ip, card, phone) are the leftmost non-overlapping matches of fixed patterns that
pass a check. The method adds spans of kind ``secret``: key-like tokens on which labelers vote for, against or
not at all: two on the token itself (a regular expression of known key forms, the mix of letters and digits, its
length), a gazetteer of credential words and one of harmless words before it, and its context (assignment or
quotes). Votes are counted by pattern over the corpus (3 to the number of labelers at most); expectation
maximisation on those counts estimates each labeler's reliability and every pattern's probability. These
probabilities train a naive Bayes classifier on features of the span, which decides.

Work is done once per different text (two 64-bit hashes) that holds a digit or an at sign, so groups of copies
of any size cost as much as one text; matches are rows, and running sums over a text's pieces give places. Loops in the patterns
run over single characters only, so that texts of any length and shape match in linear time without recursion.

Null text is empty and has no spans. Repeated rows get the same answer each. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perflog.llm.runtime import stage, text_hash

KINDS = ("email", "ip", "card", "phone", "secret")
#: Stand-ins, one code point each, for a dot between label characters and a separator between digits.
DOT, GAP = "\u0002", "\u0001"
#: Where a run of the given characters begins, or where the match before ended.
PATTERNS = {
    "email": rf"(?:(?<![A-Za-z0-9._%+{DOT}-])|\G)[A-Za-z0-9._%+{DOT}-]++@[A-Za-z0-9-]++{DOT}[A-Za-z0-9{DOT}-]++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": rf"[0-9][0-9{GAP}]++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_/+@.-])(?=[A-Za-z_/+-]*+[0-9])(?=[0-9_/+-]*+[A-Za-z])[A-Za-z0-9_/+-]{8,}+(?![@])",
}
#: Fixed word lists of the gazetteer labelers.
CREDENTIAL = "password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|credentials?|bearer|auth"
HARMLESS = "version|license|licence|isbn|issn|page|chapter|section|figure|table|volume|release"


def _with_marks(text: Column) -> dict[str, Column]:
    plain = F.translate(text, DOT + GAP, "\u0003\u0003")
    dots = F.regexp_replace(plain, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", DOT)
    gaps = F.regexp_replace(plain, r"(?<=[0-9])[\x20-](?=[0-9])", GAP)
    return {"email": dots, "ip": text, "card": gaps, "phone": text, "secret": text}


def _matches(text: Column, kind: str) -> Column:
    """kind, i, gap (length of the piece before), before (its end) and hit of every match."""
    pattern = PATTERNS[kind]
    pieces, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.transform(hits, lambda x, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("i"), F.length(F.get(pieces, i)).alias("gap"),
        (F.right(F.get(pieces, i), F.lit(24)) if kind == "secret" else F.lit("")).alias("before"), x.alias("hit")))


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + F.when(
        (n - i) % 2 == 0, F.substr(digits, i, F.lit(1)).cast("int")).otherwise(
        F.substr(digits, i, F.lit(1)).cast("int") * 2 - F.when(F.substr(digits, i, F.lit(1)).cast("int") > 4, 9).otherwise(0)))
    return total % 10 == 0


def _passes(kind: Column, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    n = F.length(digits)
    parts = F.transform(F.split(hit, r"\."), lambda p: F.ltrim(p, F.lit("0")))
    ip = F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(F.when(F.length(p) <= 3, p.try_cast("int")), F.lit(0)) <= 255))
    return (F.when(kind == "ip", ip).when(kind == "card", n.between(14, 19) & F.when(n.between(14, 19), _luhn(digits)).otherwise(False))
            .when(kind == "phone", n.between(10, 15)).otherwise(True))


def _votes(hit: Column, before: Column) -> dict[str, Column]:
    """Each labeler's vote: 1 for a secret, -1 against, 0 for none."""
    mixed = F.regexp_count(hit, F.lit("(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]"))
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    return {
        "form": vote(hit.rlike("^(AKIA[0-9A-Z]{16}|[0-9a-f]{16,}|(ghp|sk|pk|xox[abp])[_-][A-Za-z0-9]{16,})$"), hit.rlike("^[A-Za-z]+[0-9]{1,4}$")),
        "mix": vote(mixed >= 4, mixed <= 1),
        "length": vote(F.length(hit) >= 16, F.length(hit) <= 10),
        "credential": vote(before.rlike(rf"(?i)({CREDENTIAL})[^A-Za-z0-9]{{0,4}}$"), before.rlike(rf"(?i)({HARMLESS})[^A-Za-z0-9]{{0,3}}$")),
        "context": vote(before.rlike("[=:]\\s*[\"']?$"), before.rlike("[/#(]$")),
    }


LABELERS = ("form", "mix", "length", "credential", "context")


def _features(hit: Column, before: Column) -> dict[str, Column]:
    return {
        "size": F.least(F.floor(F.length(hit) / 4), F.lit(10)).cast("string"),
        "letters": F.when(hit.rlike("^[A-Z0-9]+$"), "upper").when(hit.rlike("^[0-9a-f]+$"), "hex").when(hit.rlike("[/+_-]"), "marks").otherwise("other"),
        "digits": F.floor(F.regexp_count(hit, F.lit("[0-9]")) * 5 / F.length(hit)).cast("string"),
        "front": F.coalesce(F.regexp_extract(before, "([^A-Za-z0-9\\s])\\s*$", 1), F.lit("")),
        "word": F.lower(F.regexp_extract(before, "([A-Za-z]+)[^A-Za-z]*$", 1)).isin(*CREDENTIAL.replace("[_-]?", "").replace("?", "").split("|")).cast("string"),
    }


def expectation_maximisation(patterns: DataFrame, rounds: int = 30) -> DataFrame:
    """votes, p: the probability that a span with this pattern of votes is a secret, from counts n of every pattern.

    The patterns fit in one row (at most 3 to the number of labelers). A labeler is right with one
    probability, whose prior is 8 right in 10; the class prior starts at a half."""
    logit = "ln({0} / (1 - {0}))"
    p_of = ("1 / (1 + exp(-greatest(-30D, least(30D, " + logit.format("s.prior")
            + " + aggregate(zip_with(x.votes, s.right, (v, r) -> v * " + logit.format("r") + "), 0D, (t, y) -> t + y)))))")
    one = patterns.agg(F.collect_list(F.struct("votes", "n")).alias("all"))
    right = (f"transform(sequence(0, {len(LABELERS) - 1}), j -> (8D + aggregate(w, 0D, (t, x) -> t + CASE x.votes[j] "
             "WHEN 1 THEN x.n * x.p WHEN -1 THEN x.n * (1 - x.p) ELSE 0D END)) / (10D + aggregate(w, 0D, (t, x) -> t + abs(x.votes[j]) * x.n)))")
    prior = "(1D + aggregate(w, 0D, (t, x) -> t + x.n * x.p)) / (2D + aggregate(w, 0D, (t, x) -> t + x.n))"
    step = (f"element_at(transform(array(transform(all, x -> named_struct('votes', x.votes, 'n', x.n, 'p', {p_of}))), "
            f"w -> named_struct('prior', {prior}, 'right', {right})), 1)")
    state = one.select("all", F.expr(f"aggregate(sequence(1, {rounds}), named_struct('prior', 0.5D, 'right', "
                                     f"transform(sequence(1, {len(LABELERS)}), j -> 0.8D)), (s, k) -> {step})").alias("s"))
    return state.select(F.explode(F.expr(f"transform(all, x -> named_struct('votes', x.votes, 'p', {p_of}))")).alias("x"), "s").select(
        "x.votes", "x.p", F.col("s.prior").alias("prior"), F.col("s.right").alias("right"))


def _classify(candidates: DataFrame) -> DataFrame:
    """The candidates (votes, features) that the span classifier takes for secrets."""
    patterns = candidates.groupBy("votes").agg(F.count(F.lit(1)).cast("double").alias("n"))
    p = stage(expectation_maximisation(patterns), "reliabilities")
    # a few hundred rows at most: the number of vote patterns
    soft = candidates.join(F.broadcast(p.select("votes", "p")), "votes")
    parts = soft.select("p", F.explode("features").alias("name", "value"))
    # features have few values each (the front mark is one character)
    sums = parts.groupBy("name", "value").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no"))
    total = soft.agg(F.sum("p").alias("all_yes"), F.sum(1 - F.col("p")).alias("all_no"))
    weights = sums.join(F.broadcast(total)).select(F.concat_ws("=", "name", "value").alias("key"), F.log(
        (F.col("yes") + 0.5) / (F.col("all_yes") + 1) * (F.col("all_no") + 1) / (F.col("no") + 0.5)).alias("weight"), F.log(
        (F.col("all_yes") + 1) / (F.col("all_no") + 1)).alias("base"))
    scored = (candidates.select("h1", "h2", "start", "end", "kind", F.explode("features").alias("name", "value"))
              .withColumn("key", F.concat_ws("=", "name", "value")).join(weights, "key", "left")
              .groupBy("h1", "h2", "start", "end", "kind").agg(F.sum("weight").alias("weight"), F.max("base").alias("base")))
    return scored.where(F.col("weight") + F.col("base") >= 0).select("h1", "h2", "kind", "start", "end")


def personal_spans(docs: DataFrame, text_col: str) -> DataFrame:
    """h1, h2 (text hashes), kind, start and end (code points) of every span of every different text."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    texts = (docs.select(t.alias("t")).where(F.col("t").rlike("[0-9@]"))
             .select(text_hash(F.col("t"), 1).alias("h1"), text_hash(F.col("t"), 2).alias("h2"), "t")
             .groupBy("h1", "h2").agg(F.first("t").alias("t")))
    marked = _with_marks(F.col("t"))
    rows = texts.select("h1", "h2", F.explode(F.concat(*[_matches(marked[k], k) for k in KINDS])).alias("m")).select("h1", "h2", "m.*")
    upto = Window.partitionBy("h1", "h2", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.length("hit")).over(upto)).withColumn("start", F.col("end") - F.length("hit"))
    rows = stage(rows.where(_passes(F.col("kind"), F.col("hit"))), "matches")
    votes, features = _votes(F.col("hit"), F.col("before")), _features(F.col("hit"), F.col("before"))
    candidates = rows.where("kind = 'secret'").select(
        "h1", "h2", "kind", "start", "end", F.array(*[votes[x] for x in LABELERS]).alias("votes"),
        F.create_map(*[c for k, v in features.items() for c in (F.lit(k), v)]).alias("features"))
    base = rows.where("kind != 'secret'").select("h1", "h2", "kind", "start", "end")
    return base.unionByName(_classify(candidates))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, n_email, n_ip, n_card, n_phone, base_sha256, spans (kind:start:end, comma-joined), found (array of
    start, order, kind, end) of every row, and columns named in ``extra``."""
    spans = personal_spans(docs, text_col)
    order = F.coalesce(*[F.when(F.col("kind") == k, i) for i, k in enumerate(KINDS)])
    per_text = spans.groupBy("h1", "h2").agg(F.array_sort(F.collect_list(F.struct(
        F.col("start").cast("long").alias("start"), order.alias("order"), "kind", F.col("end").cast("long").alias("end")))).alias("found"))
    t = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col), *extra, text_hash(t, 1).alias("__h1"), text_hash(t, 2).alias("__h2"))
    out = rows.join(per_text, (F.col("__h1") == F.col("h1")) & (F.col("__h2") == F.col("h2")), "left")
    found = F.coalesce("found", F.array().cast("array<struct<start:bigint,order:int,kind:string,end:bigint>>"))
    told = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    out = out.withColumn("found", found)
    base = F.filter("found", lambda x: x["order"] < 4)

    def count(kind):
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return out.select(F.col(id_col), *[count(k) for k in KINDS[:4]],
                      F.sha2(told(base), 256).alias("base_sha256"), told(F.col("found")).alias("spans"), "found", *extra)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of personal data replaced by its kind in brackets; other columns and rows stay. Of spans that overlap, the
    first stands for all. A null text stays null."""
    per_text = (personal_spans(docs, text_col).groupBy(F.col("h1").alias("__h1"), F.col("h2").alias("__h2"))
                .agg(F.array_sort(F.collect_list(F.struct("start", F.coalesce(*[F.when(F.col("kind") == k, i) for i, k in enumerate(KINDS)]).alias("order"),
                                                          "kind", "end"))).alias("__found")))
    t = F.coalesce(F.col(text_col), F.lit(""))
    may = F.coalesce(F.col(text_col).rlike("[0-9@]"), F.lit(False))
    rest, docs = docs.where(~may), docs.where(may)
    rows = docs.withColumns({"__a": text_hash(t, 1), "__b": text_hash(t, 2)})
    rows = rows.join(per_text, (F.col("__a") == F.col("__h1")) & (F.col("__b") == F.col("__h2")), "left")
    # the greatest end of the spans before each one
    ends = F.transform("__found", lambda x, i: F.when(i == 0, F.lit(0).cast("long")).otherwise(
        F.array_max(F.transform(F.slice("__found", 1, i), lambda y: y["end"])).cast("long")))
    piece = F.transform(F.arrays_zip(F.col("__found"), ends.alias("__ends")), lambda z: F.when(
        z["__found"]["start"] >= z["__ends"],
        F.concat(F.substr(F.col(text_col), (z["__ends"] + 1).cast("int"), (z["__found"]["start"] - z["__ends"]).cast("int")),
                 F.lit("["), z["__found"]["kind"], F.lit("]"))).otherwise(F.lit("")))
    last = F.array_max(F.transform("__found", lambda y: y["end"]))
    new = F.concat(F.array_join(piece, ""), F.substr(F.col(text_col), (last + 1).cast("int"), F.length(F.col(text_col))))
    return rows.withColumn(text_col, F.when(F.col("__found").isNotNull(), new).otherwise(F.col(text_col))).select(*[F.col(c) for c in docs.columns]).unionByName(rest)
