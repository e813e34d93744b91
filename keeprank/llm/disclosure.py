"""Personal data: spans by pattern, and terms whose co-occurrence with them discloses them. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keeprank.llm.line_chunks import let
from keeprank.llm.storage import settle

KINDS = ("email", "ip", "card", "phone", "term")
MIN_TEXTS = 2
DISCLOSED = 0.9
REMOVED = 0.98

# Where a run of letters for the local part starts in the middle of one, no match can begin that its start didn't allow, except
# right after a match; possessive quantifiers give the same matches here, without backtracking over long runs.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TERM = r"\p{L}{3,}"


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, value) of all matches, in code points, end exclusive."""
    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"),
                     F.transform(F.split(text, pattern, -1), lambda g: F.length(g)).alias("g"))

    def placed(s: Column) -> Column:
        total = lambda a, k: F.aggregate(F.slice(a, 1, k), F.lit(0), lambda x, y: x + y)
        lengths = F.transform(s["m"], lambda v: F.length(v))
        return let(lengths, lambda n: F.transform(s["m"], lambda v, k: let(
            total(s["g"], k + 1) + total(n, k), lambda at: F.struct(at.alias("start"), (at + F.length(v)).alias("end"), v.alias("value")))))

    return let(found, placed)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    each = F.transform(F.split(F.reverse(number), ""), lambda d: F.coalesce(d.cast("int"), F.lit(0)))
    doubled = F.transform(each, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def small_parts(value: Column) -> Column:
    bare = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    return F.forall(bare, lambda p: (F.length(p) <= 3) & (F.substring(p, 1, 3).cast("int") <= 255))


def base_spans(text: Column) -> Column:
    """Array of (start, rank, end, value), ordered; ``rank`` is the place of the kind in ``KINDS``."""
    def kind(rank: int, hint: Column, pattern: str, keep) -> Column:
        own = F.transform(F.filter(matches(text, pattern), lambda s: keep(s["value"])), lambda s: F.struct(
            s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), s["value"].alias("value")))
        return F.when(hint, own).otherwise(F.expr("CAST(array() AS ARRAY<STRUCT<start:INT,rank:INT,end:INT,value:STRING>>)"))

    digit = F.regexp_like(text, F.lit("[0-9]"))
    size = lambda v, low, high: F.length(digits(v)).between(low, high)
    return F.array_sort(F.concat(
        kind(0, F.contains(text, F.lit("@")), EMAIL, lambda v: F.lit(True)),
        kind(1, digit & F.contains(text, F.lit(".")), IP, small_parts),
        kind(2, digit, CARD, lambda v: size(v, 12, 19) & luhn(digits(v))),
        kind(3, digit & F.contains(text, F.lit("+")), PHONE, lambda v: size(v, 9, 15))))


def entity_of(span: Column) -> Column:
    return F.concat(span["rank"].cast("string"), F.lit(":"), F.lower(span["value"]))


def terms_in(text: Column) -> Column:
    """The distinct words of a text, in lower case."""
    return F.array_distinct(F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), F.lit(0))), F.lower))


def term_places(text: Column, spans: Column, terms: Column) -> Column:
    """Array of (start, rank, end, removed): every word of ``text`` whose lower case is a key of the map ``terms`` (its disclosure), outside all spans."""
    cut = F.struct(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)).alias("m"), F.split(text, TERM, -1).alias("g"))

    def placed(s: Column) -> Column:
        chosen = F.filter(F.sequence(F.lit(0), F.size(s["m"])), lambda k: (k < F.size(s["m"])) & F.map_contains_key(terms, F.lower(F.coalesce(F.get(s["m"], k), F.lit("")))))
        # Texts before a place are joined, not summed word by word: long texts have many words and few chosen ones.
        start = lambda k: F.length(F.array_join(F.slice(s["g"], 1, k + 1), "")) + F.length(F.array_join(F.slice(s["m"], 1, k), ""))
        return F.transform(chosen, lambda k: let(start(k), lambda at: F.struct(
            at.alias("start"), F.lit(4).alias("rank"), (at + F.length(F.get(s["m"], k))).alias("end"),
            (F.element_at(terms, F.lower(F.get(s["m"], k))) >= REMOVED).alias("removed"))))

    return F.filter(let(cut, placed), lambda w: ~F.exists(spans, lambda o: (w["start"] < o["end"]) & (o["start"] < w["end"])))


def find_spans(docs: DataFrame) -> DataFrame:
    """(id, digest, spans, t), settled: the pattern spans of every text, and the text where it has any; null texts have none."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").alias("id"), text.alias("t")).select(
        "id", F.xxhash64("t").alias("digest"), "t", F.explode(F.array(base_spans(F.col("t")))).alias("spans"))
    return settle(rows.select("id", "digest", "spans", F.when(F.size("spans") > 0, F.col("t")).alias("t")), "spans")


def same_text(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """``a`` with the columns of ``b(i, g, …)`` for the same id and digest."""
    return a.join(b, F.col("id").eqNullSafe(F.col("i")) & (F.col("digest") == F.col("g")), how)


def classes_of(span: Column) -> Column:
    """What an entity is generalised to: itself, the mail domain, the network, the first digits of a number, and its kind."""
    value, number = F.lower(span["value"]), digits(span["value"])
    wider = (F.when(span["rank"] == 0, F.array(F.concat(F.lit("@"), F.substring_index(value, "@", -1))))
             .when(span["rank"] == 1, F.array(*[F.concat(F.substring_index(value, ".", n), F.lit(".")) for n in (3, 2)]))
             .otherwise(F.array(*[F.concat(F.substring(number, 1, n), F.lit("…")) for n in (6, 4)])))
    rank = span["rank"].cast("string")
    return F.concat(F.array(entity_of(span), rank), F.transform(wider, lambda v: F.concat(rank, F.lit(":"), v)))


def holders_of(found: DataFrame) -> DataFrame:
    """(id, digest, entity, class): the entities of each text, each with every class that it belongs to."""
    each = found.filter("t IS NOT NULL").select("id", "digest", F.explode(F.array_distinct(F.transform("spans", lambda s: F.struct(
        entity_of(s).alias("entity"), classes_of(s).alias("classes"))))).alias("e"))
    return each.select("id", "digest", "e.entity", F.explode("e.classes").alias("class")).distinct()


def disclosing_terms(docs: DataFrame, found: DataFrame, disclosed: float = DISCLOSED, min_texts: int = MIN_TEXTS) -> DataFrame:
    """(entity, term, disclosure): pairs at or over the threshold.

    With probabilities over documents, disclosure = PMI(class, term) / IC(entity) = (log P(class | term) - log P(class)) / -log P(entity), the
    largest over the classes of the entity, of which it is one itself: 1 if the term stands only in documents that hold the entity, 0 if it
    tells nothing. A term that tells the class of a rare entity tells as much of the entity as the class does. Words count wherever they stand
    in a document, outside all spans. Copies of one document prove nothing: a pair needs ``min_texts`` different texts, and so many of
    them that chance would not be expected to make one such pair among all that were compared: texts * IC(class) >= log(pairs). An entity that is
    in every document is not disclosed by anything.
    """
    total = F.lit(max(found.count(), 1))
    held = holders_of(found)
    classes = held.select("id", "digest", "class").distinct().groupBy("class", "digest").agg(F.count("*").alias("n")).groupBy("class").agg(
        F.count("*").alias("texts"), (-F.log(F.sum("n") / total)).alias("information"))
    own = classes.select(F.col("class").alias("entity"), F.col("information").alias("whole"))
    # No pair has more texts than its class, nor a larger PMI than the information of the class: terms are only listed where both can do.
    live = settle(held.select("entity", "class").distinct().join(classes.filter(F.col("texts") >= min_texts), "class").join(own, "entity").filter(
        (F.col("whole") > 0) & (F.col("information") >= disclosed * F.col("whole"))).select("entity", "class", "information", "whole"), "classes")
    of_class = live.select("class", "information").distinct()
    listed = held.select("id", "digest", "class").distinct().join(of_class.select("class"), "class").groupBy(
        F.col("id").alias("i"), F.col("digest").alias("g")).agg(F.collect_set("class").alias("classes"))
    terms = terms_in(masked(F.col("t"), F.transform("spans", plain), F.lit(" ")))
    listed_terms = same_text(found.filter("t IS NOT NULL").dropDuplicates(["id", "digest"]), listed).select(
        "digest", "classes", F.explode(terms).alias("term")).select("digest", "term", F.explode("classes").alias("class"))
    pairs = settle(listed_terms.groupBy("class", "term", "digest").agg(F.count("*").alias("n")).groupBy("class", "term").agg(
        F.sum("n").alias("both"), F.count("*").alias("texts")), "pairs")
    compared = F.log(F.lit(max(pairs.count(), 1)))
    proven = pairs.filter(F.col("texts") >= min_texts).join(of_class, "class").filter(F.col("texts") * F.col("information") >= compared)
    frequency = docs.select(F.explode(terms_in(F.col("text").cast("string"))).alias("term")).groupBy("term").agg(F.count("*").alias("holders"))
    shared = proven.select("class", "term", "both").join(frequency, "term")
    told = F.col("information") + F.log(F.least(F.col("both") / F.col("holders"), F.lit(1.0)))
    return shared.join(live, "class").select("entity", "term", (told / F.col("whole")).alias("disclosure")).groupBy("entity", "term").agg(
        F.least(F.max("disclosure"), F.lit(1.0)).alias("disclosure")).filter(F.col("disclosure") >= disclosed)


def plain(span: Column) -> Column:
    return F.struct(span["start"].alias("start"), span["rank"].alias("rank"), span["end"].alias("end"), F.lit(False).alias("removed"))


def all_spans(docs: DataFrame, disclosed: float = DISCLOSED, min_texts: int = MIN_TEXTS) -> DataFrame:
    """(id, digest, spans, every): ``spans`` by pattern; ``every`` with the disclosing terms wherever they stand in a text that holds
    their entity, as (start, rank, end, removed)."""
    found = find_spans(docs)
    risky = settle(disclosing_terms(docs, found, disclosed, min_texts), "terms")
    terms = holders_of(found).select("id", "digest", "entity").distinct().join(risky, "entity").groupBy(F.col("id").alias("i"), F.col("digest").alias("g"), "term").agg(
        F.max("disclosure").alias("d")).groupBy("i", "g").agg(F.map_from_entries(F.collect_list(F.struct("term", "d"))).alias("terms"))
    none = F.expr("CAST(array() AS ARRAY<STRUCT<start:INT,rank:INT,end:INT,removed:BOOLEAN>>)")
    places = F.when(F.col("terms").isNull(), none).otherwise(term_places(F.col("t"), F.col("spans"), F.col("terms")))
    return same_text(found, terms, "left").select("id", "digest", "spans", F.array_sort(F.concat(F.transform("spans", plain), places)).alias("every"))


def written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["rank"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, disclosed: float = DISCLOSED, min_texts: int = MIN_TEXTS) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term.

    Counts and ``base_sha256`` are of the spans found by pattern; ``spans`` also holds the terms (kind ``term``) of the same text that disclose
    one of them by ``disclosing_terms``. Null and empty texts have no spans. Rows that repeat an id have a result each. No rows give none.
    """
    of = lambda rank: F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long")
    return all_spans(docs, disclosed, min_texts).select(
        F.col("id").alias("doc_id"), of(0).alias("n_email"), of(1).alias("n_ip"), of(2).alias("n_card"), of(3).alias("n_phone"),
        F.sha2(written(F.col("spans")), 256).alias("base_sha256"), written(F.col("every")).alias("spans"),
        F.size(F.filter("every", lambda s: s["rank"] == 4)).cast("long").alias("n_term"))


def masked(text: Column, spans: Column, mark: Column | None = None) -> Column:
    """``text`` with each span replaced: by ``mark``, else by the name of its kind in brackets, or by nothing where ``removed``. Overlapping spans are one."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def build(s: Column) -> Column:
        ends = F.transform(s, lambda x: x["end"])
        covered = lambda k: F.coalesce(F.array_max(F.slice(ends, 1, k)), F.lit(0))
        parts = F.transform(s, lambda x, k: let(covered(k), lambda c: F.when(x["start"] >= c, F.concat(
            F.substring(text, c + 1, x["start"] - c), F.when(x["removed"], F.lit("")).otherwise(names[x["rank"]] if mark is None else mark))).otherwise(F.lit(""))))
        return F.concat(F.array_join(parts, ""), F.substring(text, covered(F.size(s)) + 1, F.length(text)))

    return let(spans, build)


def sanitise(docs: DataFrame, disclosed: float = DISCLOSED, min_texts: int = MIN_TEXTS) -> DataFrame:
    """``docs`` with personal data masked and disclosing terms generalised to ``[TERM]``, or removed from a disclosure of ``REMOVED`` on.
    All rows and columns stay; texts without spans, nulls and empty texts stay as they are."""
    names = docs.columns
    every = all_spans(docs, disclosed, min_texts).filter("size(every) > 0").select("id", "digest", "every").dropDuplicates(["id", "digest"])
    wide = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")).withColumn(
        "key", F.xxhash64(F.coalesce(F.col("row.text").cast("string"), F.lit(""))))
    joined = wide.join(every, F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("digest")), "left")
    text = F.when(F.col("every").isNull(), F.col("row.text")).otherwise(masked(F.col("row.text"), F.col("every")))
    return joined.select(*[(text if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in names])
