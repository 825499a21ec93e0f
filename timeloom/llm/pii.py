"""Personal data by patterns and information-theoretic sanitisation, in DataFrame functions alone.

Patterns find e-mail addresses, IP addresses, payment cards and phone numbers: the protected entities. How often a word
stands near an entity, against how often each occurs in the corpus, tells how strongly the word reveals the entity
(its pointwise mutual information as a share of the entity's information content). Words that reveal too much are
protected as well: generalised to their class from one threshold on, removed from a second one on.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timeloom.llm.session import checkpointed

# The kinds in order and their patterns.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The patterns for the work itself. Inside of a run of the first characters nothing begins that didn't begin with the
#: run, so nothing is tried there, and no class gives back what it took: a token of n characters takes n steps, not n^2.
_LINEAR = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = "term"
#: Classes to which words are generalised.
CLASSES = ("[ABBREVIATION]", "[NAME]", "[WORD]")
#: A letter that stands for the letters of e-mail addresses while words are looked for; other texts hardly have it.
_HIDDEN = "\U0001e94b"
#: So many matches, or characters, are gone through at a time; what is appended to stays that short.
_RUN, _PAGE = 256, 4096
#: So many rows of a table of words are given to every task; a longer table is joined by shuffles instead.
_BROADCAST = 100_000
_SALTS = 32
_TERMS = "array<struct<start:int,end:int,share:double>>"
_SPANS = "array<struct<kind:int,start:int,end:int>>"


@dataclass(frozen=True)
class Disclosure:
    """``near``: code points of context on either side; ``support``: documents in which word and entity must stand
    together; ``letters``: the fewest letters of a word that can reveal anything (shorter ones are mostly function words).
    """

    near: int = 60
    support: int = 2
    generalise: float = 0.85
    remove: float = 0.95
    letters: int = 4

    @property
    def word(self) -> str:
        return rf"[\p{{L}}]{{{self.letters},}}+"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _runs(values: Column, step: Callable[[Column], Column]) -> Column:
    """``step`` of each run of at most _RUN neighbours."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(values) - 1) / _RUN), F.lit(0)).cast("int")), lambda i: step(F.slice(values, i * _RUN + 1, F.lit(_RUN))))


def _pairs(text: Column, pattern: str) -> Column:
    """Each match (``hit``) with what stands between it and the one before (``gap``); the last gap has no hit."""
    return F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))


def _found(text: Column, pattern: str) -> Column:
    """Matches with their offsets: what stands between them gives the positions that the functions don't return.

    Offsets are summed in runs, then over runs, since appending to one long array would copy it at every step.
    """

    def placed(run: Column) -> Column:
        empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,hit:string>>").alias("out"))
        return F.aggregate(
            run,
            empty,
            lambda acc, p: F.struct(
                (acc["at"] + F.length(p["gap"]) + F.length(p["hit"])).alias("at"),
                F.array_append(acc["out"], F.struct((acc["at"] + F.length(p["gap"])).alias("start"), p["hit"].alias("hit"))).alias("out"),
            ),
        )

    def joined(runs: Column) -> Column:
        empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,hit:string>>>").alias("out"))
        return F.aggregate(
            runs,
            empty,
            lambda acc, r: F.struct(
                (acc["at"] + r["at"]).alias("at"),
                F.array_append(acc["out"], F.transform(r["out"], lambda x: F.struct((acc["at"] + x["start"]).alias("start"), x["hit"].alias("hit")))).alias("out"),
            ),
            lambda acc: F.flatten(acc["out"]),
        )

    return _let(F.filter(_pairs(text, pattern), lambda p: p["hit"].isNotNull()), lambda pairs: joined(_runs(pairs, placed)))


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    at = F.sequence(F.lit(1), n)

    def value(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        doubled = d * 2
        return F.when((n - i) % 2 == 0, d).otherwise(F.when(doubled > 9, doubled - 9).otherwise(doubled))

    return F.aggregate(at, F.lit(0), lambda acc, i: acc + value(i)) % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda x: F.coalesce(x.try_cast("bigint") <= 255, F.lit(False)))
    if kind == "card":
        return _let(_digits(hit), lambda digits: F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(_digits(hit)).between(9, 15)
    return F.lit(True)


def _entities(text: Column) -> Column:
    """All valid matches of the four kinds as structs (kind, start, end, hit), by kind, then start."""
    text = F.coalesce(text, F.lit(""))
    numeric = text.rlike(r"[0-9][\x20.-]?[0-9]")
    gates = {"email": F.contains(text, F.lit("@")), "ip": numeric, "card": numeric, "phone": F.contains(text, F.lit("+"))}

    def of(k: int, kind: str) -> Column:
        valid = F.filter(_found(text, _LINEAR[kind]), lambda x: _valid(kind, x["hit"]))
        spans = F.transform(valid, lambda x: F.struct(F.lit(k).alias("kind"), x["start"].alias("start"), (x["start"] + F.length(x["hit"])).alias("end"), x["hit"].alias("hit")))
        return F.when(gates[kind], spans).otherwise(F.array().cast("array<struct<kind:int,start:int,end:int,hit:string>>"))

    return F.concat(*[of(k, kind) for k, kind in enumerate(KINDS)])


def base_spans(text: Column) -> Column:
    """All valid matches of the four kinds as structs (kind, start, end), by kind, then start; null texts have none."""
    return F.transform(_entities(text), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def written(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    names = F.array(*[F.lit(x) for x in (*KINDS, TERM)])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _pages(text: Column) -> Column:
    """The text in pages of _PAGE code points, as a substring counts its code points from the front."""
    return _let(text, lambda t: F.transform(F.sequence(F.lit(0), F.floor(F.length(t) / _PAGE).cast("int")), lambda i: F.substring(t, i * _PAGE + 1, F.lit(_PAGE))))


def _piece(pages: Column, start: Column, end: Column) -> Column:
    """The code points from ``start`` to ``end`` (exclusive) of a text in pages."""
    first = F.floor(start / _PAGE).cast("int")
    last = F.floor(end / _PAGE).cast("int")
    return F.substring(F.array_join(F.slice(pages, first + 1, last - first + 1), ""), start - first * _PAGE + 1, end - start)


def _windows(text: Column, rule: Disclosure) -> Column:
    """For each entity a struct: ``entity`` (digest of its lower-cased form), ``from``, ``window`` and ``at_end``, where letters
    of e-mail addresses, the only entities with letters, are hidden."""
    hidden = F.array_join(F.transform(_pairs(text, _LINEAR["email"]), lambda p: F.concat(p["gap"], F.regexp_replace(F.coalesce(p["hit"], F.lit("")), "[A-Za-z]", _HIDDEN))), "")
    hidden = F.when(F.contains(text, F.lit("@")), hidden).otherwise(text)

    def window(v: Column, s: Column) -> Column:
        begin = F.greatest(F.lit(0), s["start"] - rule.near)
        return F.struct(
            F.md5(F.lower(s["hit"]).cast("binary")).alias("entity"),
            begin.alias("from"),
            _piece(v["pages"], begin, s["end"] + rule.near).alias("window"),
            (s["end"] + rule.near >= v["n"]).alias("at_end"),
        )

    return _let(F.struct(_entities(text).alias("found"), _pages(hidden).alias("pages"), F.length(text).alias("n")), lambda v: F.transform(v["found"], lambda s: window(v, s)))


def _near(held: DataFrame, rule: Disclosure) -> DataFrame:
    """A row for each word that stands whole within ``near`` code points of an entity and in no entity itself."""
    here = held.select("id", "key", F.explode("windows").alias("s")).select("id", "key", "s.*")
    terms = here.select("id", "key", "entity", "from", "at_end", F.length("window").alias("width"), F.explode(_found(F.col("window"), rule.word)).alias("w"))
    end = F.col("w.start") + F.length("w.hit")
    whole = ((F.col("w.start") > 0) | (F.col("from") == 0)) & ((end < F.col("width")) | F.col("at_end"))
    return (
        terms.where(whole & ~F.contains("w.hit", F.lit(_HIDDEN)))
        .select("id", "key", "entity", F.lower("w.hit").alias("term"), (F.col("from") + F.col("w.start")).alias("start"), (F.col("from") + end).alias("end"))
    )


def _repeated(docs: DataFrame) -> DataFrame:
    """The ids that several rows have (id, again), with the number of rows ``n``."""
    return checkpointed(docs.where("id is not null").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.col("id").alias("again"), "n"))


def _documents_of(words: DataFrame, repeated: DataFrame) -> DataFrame:
    """In how many documents each term stands (term, n_term), from the distinct words (id, term) of each row.

    The rows of an id that has one are counted before they are shuffled; only words of ids with more rows go along with
    their id, to count once.
    """
    again = repeated.select("id", "again")
    many = again.count()
    if not many:
        words = words.withColumn("again", F.lit(None).cast("string"))
    elif many <= _BROADCAST:
        words = words.join(F.broadcast(again), "id", "left")
    else:
        words = words.withColumn("again", F.col("id"))
    by_row = words.groupBy("term", "again").agg(F.count("id").alias("n"))
    return by_row.groupBy("term").agg(F.sum(F.when(F.col("again").isNull(), F.col("n")).otherwise(1)).alias("n_term"))


def disclosing(docs: DataFrame, held: DataFrame, rule: Disclosure) -> DataFrame:
    """Spans of the words that reveal an entity near them: (id, key, start, end, share), for each word its largest share.

    ``docs`` has the columns id and text, ``held`` (id, key, windows) for those with entities. Frequencies are numbers of
    distinct ids over all documents. Tables of words go to every task only while they are short.
    """
    repeated = _repeated(docs)
    n_docs = F.lit(docs.count() - (repeated.agg(F.sum(F.col("n") - 1)).first()[0] or 0))
    near = _near(held, rule)
    pairs = near.select("id", "entity", "term").distinct()
    together = checkpointed(pairs.groupBy("entity", "term").agg(F.count("id").alias("n_both")).where(F.col("n_both") >= rule.support))
    entities = held.select("id", F.explode("windows.entity").alias("entity")).distinct().groupBy("entity").agg(F.count("id").alias("n_entity"))
    words = (
        docs.where("text is not null")
        .select("id", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]++"))).alias("term"))
        .where(F.length("term") >= rule.letters)
    )
    counts = _documents_of(words, repeated)
    content = F.log2(n_docs / F.col("n_entity"))
    mutual = F.log2(F.col("n_both") * n_docs / (F.col("n_term") * F.col("n_entity")))
    revealing = checkpointed(
        together.join(entities, "entity")
        .join(counts, "term")
        .where(content > 0)
        .select("entity", "term", (mutual / content).alias("share"))
        .where(F.col("share") >= rule.generalise)
    )
    if revealing.count() <= _BROADCAST:
        found = near.join(F.broadcast(revealing), ["entity", "term"])
    else:  # an entity and a word may stand together in a third of all rows
        dealt = revealing.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
        found = near.withColumn("salt", F.pmod(F.xxhash64("id", "key", "start"), F.lit(_SALTS)).cast("int")).join(dealt, ["entity", "term", "salt"])
    return found.groupBy("id", "key", "start", "end").agg(F.max("share").alias("share"))


def _key(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def _terms(base: DataFrame, rule: Disclosure) -> DataFrame:
    """For each text with words that reveal an entity, and each id that it has: ``__id``, ``__key`` and ``__terms``, by start."""
    held = base.select("id", _key(F.col("text")).alias("key"), _windows(F.col("text"), rule).alias("windows")).where(F.size("windows") > 0)
    found = disclosing(base, checkpointed(held), rule)
    return found.groupBy(F.col("id").alias("__id"), F.col("key").alias("__key")).agg(F.array_sort(F.collect_list(F.struct("start", "end", "share"))).alias("__terms"))


def _with_terms(rows: DataFrame, terms: DataFrame, id_column: str, text: Column) -> DataFrame:
    """``rows`` with ``__terms``: those of their own text, also where ids are null or rows of other texts have the same id."""
    joined = rows.join(terms, F.col(id_column).eqNullSafe(F.col("__id")) & (_key(text) == F.col("__key")), "left")
    return joined.withColumn("__terms", F.coalesce("__terms", F.array().cast(_TERMS)))


def find(docs: DataFrame, rule: Disclosure = Disclosure(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: ``id``, ``text`` ('' if null), ``spans`` (base) and ``terms`` (start, end, share; by start).

    Null and empty texts have no spans. Frequencies count distinct ids: rows that share one count once for each word, a
    row without an id adds to the number of documents alone, and each row gets the spans of its own text. If every
    document has an entity, the entity has no information content and nothing reveals it. Further columns are ignored,
    and an empty table gives an empty result.
    """
    base = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    rows = base.select("id", "text", base_spans(F.col("text")).alias("spans"))
    return _with_terms(rows, _terms(base, rule), "id", F.col("text")).select("id", "text", "spans", F.col("__terms").alias("terms"))


def sanitise(docs: DataFrame, rule: Disclosure = Disclosure(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents with all their columns and sanitised texts; null texts stay null, rows without entities as they are.

    The cases are those of find(): each row is sanitised by its own text, whatever its id. A column named like one of
    the operator's own is left alone.
    """
    base = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    rows = docs.withColumn("__spans", base_spans(F.col(text_column)))
    joined = _with_terms(rows, _terms(base, rule), id_column, F.coalesce(F.col(text_column), F.lit("")))
    text = F.when(F.col(text_column).isNotNull(), sanitised(F.col(text_column), F.col("__spans"), F.col("__terms"), rule))
    return joined.select(*[text.alias(c) if c == text_column else F.col(f"`{c}`") for c in docs.columns])


def all_spans(spans: Column, terms: Column) -> Column:
    """Base spans, then those of terms, as structs (kind, start, end)."""
    return F.concat(spans, F.transform(terms, lambda t: F.struct(F.lit(len(KINDS)).alias("kind"), t["start"].alias("start"), t["end"].alias("end"))))


def generalised(word: Column) -> Column:
    """The class of a word: an abbreviation (capitals alone), a name (a capital first), or any other word."""
    return F.when(word.rlike(r"^\p{Lu}{2,}$"), CLASSES[0]).when(word.rlike(r"^\p{Lu}"), CLASSES[1]).otherwise(CLASSES[2])


def sanitised(text: Column, spans: Column, terms: Column, rule: Disclosure = Disclosure()) -> Column:
    """The text with entities as [EMAIL], [IP], [CARD] or [PHONE], generalised words as their class, removed words left out.

    Of spans that overlap, the one that begins first (then the longer one, then the first kind) stands for all.
    """
    labels = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    mark = lambda s, kind, put: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), kind.alias("kind"), put.alias("put"))
    kept = lambda acc: F.struct(acc["at"].alias("at"), acc["out"].alias("out"))

    def cut(v: Column) -> Column:
        word = lambda t: generalised(_piece(v["pages"], t["start"], t["end"]))
        marks = F.concat(
            F.transform(spans, lambda s: mark(s, s["kind"], F.element_at(labels, s["kind"] + 1))),
            F.transform(terms, lambda t: mark(t, F.lit(len(KINDS)), F.when(t["share"] >= rule.remove, F.lit("")).otherwise(word(t)))),
        )

        def step(acc: Column, m: Column) -> Column:
            seen = F.struct(F.greatest(acc["at"], -m["back"]).alias("at"), acc["out"].alias("out"))
            put = F.concat(acc["out"], F.array(_piece(v["pages"], acc["at"], m["start"]), m["put"]))
            return F.when(m["start"] < acc["at"], seen).otherwise(F.struct((-m["back"]).alias("at"), put.alias("out")))

        def run(acc: Column, marks: Column) -> Column:
            part = F.aggregate(marks, F.struct(acc["at"].alias("at"), F.array().cast("array<string>").alias("out")), step, kept)
            return _let(part, lambda r: F.struct(r["at"].alias("at"), F.array_append(acc["out"], F.array_join(r["out"], "")).alias("out")))

        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
        whole = _let(F.array_sort(marks), lambda m: F.aggregate(_runs(m, lambda x: x), start, run, kept))
        return _let(whole, lambda w: F.concat(F.array_join(w["out"], ""), _piece(v["pages"], w["at"], F.greatest(v["n"], w["at"]))))

    bound = F.struct(_pages(text).alias("pages"), F.length(text).alias("n"))
    return F.when(F.size(spans) + F.size(terms) == 0, text).otherwise(_let(bound, cut))
