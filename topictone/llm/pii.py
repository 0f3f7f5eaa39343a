"""Personal data: known formats, and information-theoretic sanitisation.

Everything here is DataFrame operations.

Base spans are four patterns.  Positions come from splitting the text at the
pattern: matches and the pieces between them, whose lengths add up.  The patterns
are possessive and anchored where a match can start, which finds the same matches
in linear time and without recursion.

The method: an address or number found is a protected *entity*, the words of a text
outside its addresses are *terms*.  Both are counted over all *units* of the corpus:
a unit is a text, or of a longer text each PASSAGE characters (a run of word or
address characters stays in the unit where it begins).  The pointwise mutual
information of term t and entity e is ``ln(N * n(t, e) / (n(t) * n(e)))``, and the
information content of e is ``ln(N / n(e))``.  Their ratio is the share of the entity
that the term gives away: 1 if it stands in no unit without the entity.  A term whose
ratio reaches ``generalise`` for some entity (met in at least SUPPORT units of
different text, as copies of one text prove nothing) is a span of kind ``term``
wherever it stands, in texts without the entity too.  From ``remove`` on it is
removed, below that it is generalised to the class of its spelling.

Exact bounds keep the pairs few.  An entity in fewer than SUPPORT different units has
no term, and a term can only reach the ratio if ``n(t) <= n(e)**g * N**(1-g)``: the
words in more than a COMMON-th of the units (at most COMMON times the words of a unit)
are broadcast with the least n(e) they need.  Entities of very many units are joined
salted, and the pairs are counted per unit text first.

Null texts count as empty.  Equal rows (id and text) give equal rows.  Texts of any
length are scanned whole.  An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, digest, write_shared

#: Kinds in the order in which spans that start at one place are listed, with
#: their patterns (Java syntax; linear forms of the given ones).
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = (*PATTERNS, "term")
#: What replaces a span of each kind in a sanitised text.
MASKS = {k: f"[{k.upper()}]" for k in PATTERNS}
PASSAGE, SUPPORT, GENERALISE, REMOVE, SALTS, COMMON, STEP = 4000, 2, 0.9, 0.99, 16, 1000, 256
BROADCAST = 16 << 20
WORD = r"[\p{L}][\p{L}\p{M}'-]{2,}+"
#: An address (group 1 empty) or a word; and what a unit's end doesn't cut.
TERM = rf"(?:{PATTERNS['email']})|({WORD})"
RUN = r"[\p{L}\p{M}0-9'@._%+-]"
SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), 0)


def places(text: Column, pattern: str, kind: int) -> Column:
    """Array of (start, kind, end, value) of the pattern's matches in code points."""
    pieces = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.arrays_zip(F.slice(pieces, 1, F.greatest(F.size(found), F.lit(1))).alias("piece"), found.alias("match")),
                       lambda x: F.struct(F.length(x["piece"]).alias("gap"), x["match"].alias("value")))

    def run(step, start):
        """Spans of up to STEP matches, places counted from ``start``."""
        first = F.struct(start.alias("at"), F.array().cast(SPAN).alias("out"))

        def add(acc, x):
            begin = acc["at"] + x["gap"]
            end = begin + F.length(x["value"])
            span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["value"].alias("value"))
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

        return F.aggregate(step, first, add)

    # Appending copies an array, so long lists are built in steps, each from 0, and
    # then moved to where the steps before end.
    def steps(pairs):
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / STEP).cast("int")),
                           lambda i: run(F.slice(pairs, i * STEP + 1, F.lit(STEP)), F.lit(0)))

    moved_type = f"array<struct<by:int,out:{SPAN}>>"

    def move(acc, x):
        part = F.struct(acc["at"].alias("by"), x["out"].alias("out"))
        return F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["parts"], F.array(part)).alias("parts"))

    def moved(p):
        return F.transform(p["out"], lambda s: F.struct(
            (s["start"] + p["by"]).alias("start"), s["kind"].alias("kind"), (s["end"] + p["by"]).alias("end"), s["value"].alias("value")))

    def spans(pairs):
        many = F.aggregate(steps(pairs), F.struct(F.lit(0).alias("at"), F.array().cast(moved_type).alias("parts")), move,
                           lambda acc: F.flatten(F.transform(acc["parts"], moved)))
        return F.when(F.size(pairs) <= STEP, run(pairs, F.lit(0))["out"]).otherwise(many)

    return F.when(F.regexp_like(text, F.lit(pattern)), _let(gaps, spans)).otherwise(F.array().cast(SPAN))


def _luhn(digits: Column) -> Column:
    """Whether a digit string passes: every second digit from the right doubled."""
    n = F.length(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), n), F.lit(0),
        lambda acc, i: acc + F.when((n - i) % 2 == 0, F.substring(digits, i, F.lit(1)).cast("int")).otherwise(
            F.element_at(F.array(*(F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), F.substring(digits, i, F.lit(1)).cast("int") + 1)))
    return total % 10 == 0


def _passes(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        def fits(part):
            v = F.ltrim(part, F.lit("0"))
            return F.when(F.length(v) > 3, F.lit(False)).when(v == "", F.lit(True)).otherwise(v.cast("int") <= 255)
        return F.forall(F.split(value, r"\."), fits)
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """All base spans in the listed order."""
    def of(i: int, kind: str, pattern: str) -> Column:
        return F.filter(places(text, pattern, i), lambda s: _passes(kind, s["value"]))

    return F.array_sort(F.concat(*(of(i, k, p) for i, (k, p) in enumerate(PATTERNS.items()))))


def joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))


def _row_key(id_col: str, text: Column) -> Column:
    """Rows of equal id and text have one key."""
    return F.unhex(F.sha2(F.concat(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.lit("\u0000"), text), 256))


def _units(rows: DataFrame) -> DataFrame:
    """``rows`` (with ``text``) once per unit: its number ``unit``, its text ``piece`` and
    where that begins."""
    def last_in_run(piece):
        return F.regexp_like(F.substring(piece, -1, 1), F.lit(RUN))

    def lead(piece):
        return F.regexp_extract(piece, f"^{RUN}*+", 0)

    def whole(piece, i):
        """Without the end of a run that began before, with the end of its own last run."""
        before, after = F.coalesce(F.get("cut", i - 1), F.lit("")), F.coalesce(F.get("cut", i + 1), F.lit(""))
        own = F.when(last_in_run(before), F.substring(piece, F.length(lead(piece)) + 1, F.length(piece))).otherwise(piece)
        return F.concat(own, F.when(last_in_run(piece), lead(after)).otherwise(F.lit("")))

    def placed(size):
        return F.transform("pieces", lambda p, i: F.struct(p.alias("piece"), F.aggregate(
            F.slice(size, 1, i), F.lit(0), lambda acc, n: acc + n).alias("begin")))

    cut = F.when(F.length("text") > PASSAGE, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PASSAGE}}}"), F.lit(0)))
    return (rows.withColumn("cut", cut)
            .withColumn("pieces", F.when(F.col("cut").isNull(), F.array("text")).otherwise(F.transform("cut", whole)))
            .select(*(F.col(c) for c in rows.columns if c != "text"),
                    F.posexplode(_let(F.transform("pieces", F.length), placed)).alias("unit", "at"))
            .select(*(F.col(c) for c in rows.columns if c != "text"), "unit", "at.piece", "at.begin"))


def _bounded_join(rows: DataFrame, small: DataFrame, col: str, other: str) -> DataFrame:
    """Inner join with ``small`` (written, ``col`` unique): broadcast within BROADCAST
    bytes, beyond them shuffled with the rows of one ``col`` dealt by ``other``."""
    size = small.agg(F.coalesce(F.sum(F.octet_length(col) + 24), F.lit(0))).first()[0]
    if size <= BROADCAST:
        return rows.join(F.broadcast(small), col)
    dealt = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int")).join(dealt, [col, "salt"]).drop("salt")


def _words(piece: Column) -> Column:
    """The different words of a unit outside its addresses, in lower case."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(piece), F.lit(TERM), F.lit(1)), lambda w: w != ""))


def _scanned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, key (equal for equal rows), length and base spans, written once without texts."""
    text = _text(text_col)
    found = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"))
    return write_shared(found.select("id", _row_key("id", F.col("text")).alias("key"), F.length("text").alias("length"),
                                     base_spans(F.col("text")).alias("base")), "pii-scan")


def _entity(span: Column) -> Column:
    return F.concat_ws(":", span["kind"], F.lower(span["value"]))


def _disclosing(docs: DataFrame, scan: DataFrame, text_col: str, generalise: float, remove: float) -> DataFrame:
    """word, removed: the terms over the threshold for some entity, by unit counts."""
    texts = docs.select(_text(text_col).alias("text"))
    total = int(scan.agg(F.sum(F.greatest(F.lit(1), F.ceil(F.col("length") / PASSAGE)))).first()[0] or 0)
    # Unit counts of all words of all texts, summed in the tasks first.
    freq = write_shared(_units(texts).select(F.explode(_words(F.col("piece"))).alias("word"))
                        .groupBy("word").agg(F.count(F.lit(1)).alias("n_word")), "pii-words")
    # Units with an entity: their entities and words, written once.
    found = texts.withColumn("base", base_spans(F.col("text"))).filter(F.size("base") > 0)
    here = F.filter("base", lambda s: F.floor(s["start"] / PASSAGE) == F.col("unit"))
    units = write_shared(
        _units(found).withColumn("entities", F.array_distinct(F.transform(here, _entity))).filter(F.size("entities") > 0)
        .select("entities", F.xxhash64("piece").alias("unit_text"), _words(F.col("piece")).alias("words")), "pii-units")
    uses = units.select("words", "unit_text", F.explode("entities").alias("entity"))
    entities = (uses.groupBy("entity", "unit_text").agg(F.count(F.lit(1)).alias("n"))
                .groupBy("entity").agg(F.sum("n").alias("n_entity"), F.count(F.lit(1)).alias("different"))
                .filter((F.col("different") >= SUPPORT) & (F.col("n_entity") < total)).drop("different"))
    entities = write_shared(entities, "pii-entities")
    n = float(max(total, 1))
    common = freq.filter(F.col("n_word") > n / COMMON).select("word", F.pow(
        F.col("n_word") / F.lit(n ** (1 - generalise)), F.lit(1 / generalise)).alias("least"))
    # The bound is taken a little low, so that rounding drops no pair.
    pairs = (_bounded_join(uses, entities, "entity", "unit_text").select("entity", "n_entity", "unit_text", F.explode("words").alias("word"))
             .join(F.broadcast(common), "word", "left").filter("least IS NULL OR n_entity >= least * 0.999")
             .groupBy("entity", "word", "n_entity", "unit_text").agg(F.count(F.lit(1)).alias("n"))
             .groupBy("entity", "word", "n_entity").agg(F.sum("n").alias("both"), F.count(F.lit(1)).alias("different"))
             .filter(F.col("different") >= SUPPORT))
    share = F.log(F.lit(n) * F.col("both") / (F.col("n_word") * F.col("n_entity"))) / F.log(F.lit(n) / F.col("n_entity"))
    over = pairs.join(freq, "word").withColumn("share", share).filter(F.col("share") >= generalise)
    return write_shared(over.groupBy("word").agg(F.max(F.col("share") >= remove).alias("removed")), "pii-terms")


def _term_spans(docs: DataFrame, scan: DataFrame, terms: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """key, found: the disclosing places of each row that has some, once each."""
    text = _text(text_col)
    units = _units(docs.select(_row_key(id_col, text).alias("key"), text.alias("text")))
    words = units.select("key", "unit", F.explode(_words(F.col("piece"))).alias("word"))
    hits = _bounded_join(words, terms, "word", "key").groupBy("key", "unit").agg(F.collect_set(F.struct("word", "removed")).alias("hits"))
    # A unit has at most PASSAGE / 3 words.  Only units with a hit are searched for places.
    hits = write_shared(hits, "pii-hits")
    tag = F.xxhash64("key", "unit").alias("tag")
    tags = hits.select(tag).distinct()
    if hits.count() * 16 <= BROADCAST:  # else all texts travel once
        units = units.withColumn("tag", tag).join(F.broadcast(tags), "tag", "left_semi").drop("tag")
    keys = hits.select("key").distinct()

    def hit(s):
        return F.get(F.filter("hits", lambda h: h["word"] == F.lower(s["value"])), 0)

    marked = F.filter(F.transform(places(F.col("piece"), TERM, len(PATTERNS)), lambda s: F.struct(
        (s["start"] + F.col("begin")).alias("start"), (s["end"] + F.col("begin")).alias("end"), s["value"].alias("value"), hit(s).alias("hit"))),
        lambda s: s["hit"].isNotNull())
    one = (units.join(hits, ["key", "unit"]).select("key", F.explode(marked).alias("s"))
           .groupBy("key", "s.start", "s.end").agg(F.max("s.hit.removed").alias("removed"), F.max("s.value").alias("value")))
    found = one.groupBy("key").agg(F.collect_list(F.struct(
        "start", F.lit(len(PATTERNS)).alias("kind"), "end", "value", "removed")).alias("found"))
    # A word that an address begins in is the address's.
    base = scan.select("key", "base").filter(F.size("base") > 0).join(keys, "key", "left_semi").dropDuplicates(["key"])
    free = F.filter("found", lambda t: ~F.exists("base", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    return (found.join(base, "key", "left").select("key", F.when(F.col("base").isNull(), F.col("found")).otherwise(free).alias("found")))


def personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                  generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """Per document: id, n_email, n_ip, n_card, n_phone, n_term, base_sha256, spans."""
    scan = _scanned(docs, id_col, text_col)
    found = _term_spans(docs, scan, _disclosing(docs, scan, text_col, generalise, remove), id_col, text_col)
    out = scan.select("id", "key", "base").join(found, "key", "left")
    plain = F.transform(F.coalesce("found", F.array().cast("array<struct<start:int,kind:int,end:int,value:string,removed:boolean>>")),
                        lambda s: F.struct(s["start"], s["kind"], s["end"], s["value"])).cast(SPAN)
    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")

    return out.select(F.col("id").alias(id_col), *(count(i).alias(f"n_{k}") for i, k in enumerate(PATTERNS)),
                      F.size(plain).cast("long").alias("n_term"), digest(joined(F.col("base"))).alias("base_sha256"),
                      joined(F.array_sort(F.concat("base", plain))).alias("spans"))


def sanitise(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
             generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """``docs`` with all columns and rows: base spans masked, disclosing terms
    generalised or removed; other texts unchanged."""
    key, spans, tag = free_names(docs, "row_key", "row_spans", "row_tag")
    scan = _scanned(docs, id_col, text_col)
    found = _term_spans(docs, scan, _disclosing(docs, scan, text_col, generalise, remove), id_col, text_col)
    full = "array<struct<start:int,kind:int,end:int,value:string,removed:boolean>>"
    base = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"),
                                                  s["value"].alias("value"), F.lit(False).alias("removed")))
    based = scan.filter(F.size("base") > 0).select("key", "base").dropDuplicates(["key"])
    edits = write_shared(based.join(found, "key", "full_outer").select(F.col("key").alias(key), F.array_sort(F.concat(
        F.coalesce(base, F.array().cast(full)), F.coalesce("found", F.array().cast(full)))).alias(spans)), "pii-edits")
    # Only rows with a span are moved by the join, while a tag of each fits a broadcast.
    some, same = docs.withColumn(key, _row_key(id_col, _text(text_col))), None
    if edits.count() * 16 <= BROADCAST:
        tags = F.broadcast(edits.select(F.xxhash64(key).alias(tag)).distinct())
        marked = some.withColumn(tag, F.xxhash64(key))
        some, same = (marked.join(tags, tag, how) for how in ("left_semi", "left_anti"))
    some = some.join(edits, key, "left")

    def step(acc, s):
        """Spans by start; one that begins inside the last is already gone."""
        mask = F.element_at(F.array(*(F.lit(m) for m in MASKS.values())), F.least(s["kind"] + 1, F.lit(len(MASKS))))
        shown = F.when(s["kind"] < len(PATTERNS), mask).when(s["removed"], F.lit("")).when(
            F.regexp_like(s["value"], F.lit("^[A-Z]")), F.lit("[NAME]")).otherwise(F.lit("[WORD]"))
        piece = F.concat(F.substring(F.col(f"`{text_col}`"), acc["at"] + 1, s["start"] - acc["at"]), shown)
        return F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(piece)).alias("out"))).otherwise(
            F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out")))

    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    clean = F.aggregate(spans, empty, step, lambda acc: F.concat(
        F.array_join(acc["out"], ""), F.substring(F.col(f"`{text_col}`"), acc["at"] + 1, F.length(F.col(f"`{text_col}`")))))
    edited = some.withColumn(text_col, F.when(F.size(spans) > 0, clean).otherwise(F.col(f"`{text_col}`")))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return edited.select(*columns) if same is None else edited.select(*columns).unionByName(same.select(*columns))
