"""Text predicates, normal forms, time stamps and salvage of broken documents, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timeloom.functions.ratio import bound, let, similar, similarity  # noqa: F401

_SPACE = r"(?U)\s+"
#: Opening phrases of on-screen overlays are matched case-insensitively, watermark words likewise.
WATERMARK = r"(?i)watermark|douyin|tiktok|kuaishou|bilibili"


def squeezed(text: Column) -> Column:
    """No white space, lower case."""
    return F.lower(F.regexp_replace(text, _SPACE, ""))


def unspaced(text: Column) -> Column:
    """No white space, case kept."""
    return F.regexp_replace(text, _SPACE, "")


def bare_title(text: Column) -> Column:
    """Letters and digits of any script only."""
    return F.regexp_replace(text, r"(?U)[\s\W_]+", "")


def bare_line(text: Column) -> Column:
    """No white space and no common punctuation of either width."""
    return F.regexp_replace(F.regexp_replace(text, _SPACE, ""), "[,.!?;:，。！？；：、…—\"'“”‘’()（）\\-]", "")


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def han_count(text: Column) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, "[一-鿿]++", ""))


def latin_count(text: Column) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, "[A-Za-z]++", ""))


def closing_count(text: Column) -> Column:
    """The number of closing brackets, plain and wide."""
    return F.length(text) - F.length(F.translate(text, ")）", ""))


def occurrences(text: Column, part: Column) -> Column:
    """How often a part stands in a text without overlaps; 0 for an empty part."""
    n = F.length(part)
    return F.when(n > 0, ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / n).cast("int")).otherwise(0)


def phrase_loop(text: Column) -> Column:
    """Whether the first 8 to 20 characters stand three times, or a 12-character window of the first quarter does.

    For lines; its time grows with the square of the length. ``phrase_loop_of_text`` is for whole documents.
    """
    n = F.length(text)
    starts = F.exists(F.sequence(F.lit(8), F.lit(20)), lambda k: (n >= 3 * k) & (occurrences(text, F.substring(text, F.lit(1), k)) >= 3))
    windows = F.when(n >= 36, F.exists(F.sequence(F.lit(1), F.greatest(F.lit(1), (n / 4).cast("int"))), lambda i: occurrences(text, F.substring(text, i, F.lit(12))) >= 3)).otherwise(F.lit(False))
    return starts | windows


def few_symbols(text: Column) -> Column:
    """At least eight characters, of at most two kinds: nothing is left without the first one and the first of the others."""
    others = F.replace(text, F.substring(text, 1, 1), F.lit(""))
    return (F.length(text) >= 8) & (F.replace(others, F.substring(others, 1, 1), F.lit("")) == "")


def foreign(text: Column) -> Column:
    """Ten Latin letters or more with fewer than three Han characters."""
    return (latin_count(text) >= 10) & (han_count(text) < 3)


def hallucinated(text: Column) -> Column:
    """Recognised speech that no one said: empty, closing brackets, one character or phrase over and over, a foreign line."""
    t = trimmed(F.coalesce(text, F.lit("")))
    return (t == "") | (closing_count(t) >= 4) | t.rlike(r"(?s)(.)\1{5,}") | few_symbols(t) | phrase_loop(t) | foreign(t)


def usable_line(text: Column) -> Column:
    # what rules most lines out comes first: loops are looked for in the rest alone
    return (trimmed(F.coalesce(text, F.lit(""))) != "") & (han_count(text) >= 2) & ~hallucinated(text)


def dialogue_caption(text: Column, overlay: str = "^$") -> Column:
    t = unspaced(F.coalesce(text, F.lit("")))
    return (F.length(t) >= 2) & (han_count(t) >= 2) & ~t.rlike(overlay)


def region(y: Column) -> Column:
    """Where on the screen a text stands, by its centre's share of the height."""
    return F.when(y >= 0.72, "bottom").when(y <= 0.22, "title").otherwise("other")


def watermark(text: Column, where: Column) -> Column:
    edge = where.isin("title", "other")
    return (text.rlike(WATERMARK) & edge) | ((F.length(text) <= 2) & edge) | (F.contains(text, F.lit("@")) & (where == "title") & (F.length(text) < 24))


def canonical_label(label: Column, names: dict[str, str]) -> Column:
    """The English half of a ``local/english`` label, through a table of names."""
    english = F.lower(F.trim(F.element_at(F.split(label, "/"), -1)))
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, english), english)


def subtitle_time(ms: Column) -> Column:
    """H:MM:SS.cc of a time; hundredths carry into seconds, seconds into minutes."""
    cs = F.bround(F.greatest(F.lit(0), ms) / 10).cast("long")
    return F.format_string("%d:%02d:%02d.%02d", F.floor(cs / 360000), F.floor(cs / 6000) % 60, F.floor(cs / 100) % 60, cs % 100)


def stamp(ms: Column) -> Column:
    """MM:SS.mmm."""
    ms = ms.cast("long")
    return F.format_string("%02d:%02d.%03d", F.floor(ms / 60000), F.floor(ms / 1000) % 60, ms % 1000)


def subtitle_escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), r"([{}])", r"\\$1"), r"\r?\n", r"\\N")


def subtitle_colour(colour: Column) -> Column:
    """#RRGGBB as a &HBBGGRR& tag; '' for anything else."""
    return F.when(colour.rlike("^#?[0-9A-Fa-f]{6}$"), F.upper(F.regexp_replace(colour, "^#?(..)(..)(..)$", r"&H$3$2$1&"))).otherwise("")


def styled(runs: Column) -> Column:
    """Runs of (text, color) as one subtitle text with colour tags."""

    def one(r):
        tag = subtitle_colour(r["color"])
        return F.when(tag != "", F.concat(F.lit("{\\c"), tag, F.lit("}"), subtitle_escape(r["text"]))).otherwise(subtitle_escape(r["text"]))

    return F.array_join(F.transform(runs, one), "")


def salvaged_number(text: Column) -> Column:
    """The number in a text that has stray characters around or in it; NULL if there is none."""
    return F.regexp_replace(text, r"[^0-9.\-]", "").try_cast("double")


def aspect_label(width: Column, height: Column) -> Column:
    """The standard ratio within 0.04, or else the reduced one."""
    ratio = width / height
    near = F.array_min(F.transform(F.array(*[F.struct(F.lit(w / h).alias("r"), F.lit(f"{w}:{h}").alias("name")) for w, h in ((16, 9), (9, 16), (4, 3), (3, 4), (1, 1), (21, 9))]), lambda x: F.struct(F.abs(x["r"] - ratio).alias("d"), x["name"].alias("name"))))
    # Euclid's steps: 64 are enough for 32-bit sizes
    gcd = F.aggregate(F.sequence(F.lit(1), F.lit(64)), F.struct(width.cast("long").alias("a"), height.cast("long").alias("b")), lambda acc, _: F.when(acc["b"] == 0, acc).otherwise(F.struct(acc["b"].alias("a"), F.try_mod(acc["a"], acc["b"]).alias("b"))), lambda acc: acc["a"])
    reduced = F.concat_ws(":", (width / gcd).cast("long").cast("string"), (height / gcd).cast("long").cast("string"))
    return F.when(near["d"] <= 0.04, near["name"]).otherwise(reduced)


def without_thoughts(text: Column) -> Column:
    """Text without <think> blocks."""
    return F.regexp_replace(text, r"(?is)<think>.*?</think>", "")


def _documents(text: Column, tries: int) -> Column:
    """Where each of the first ``tries`` opening brackets of a text stands and where it is closed, brackets inside strings left
    out, as (at, end) from 1; ``end`` is 0 if it never is.

    One fold over the marks that matter and what stands between them, for all of them at once: seen from one bracket, a mark
    is inside a string if the quotes between them are odd, so it counts for the brackets with as many quotes before them as
    it has itself, modulo 2.
    """
    parts = F.regexp_extract_all(text, F.lit(r'(?s)\\.|["{}\[\]]|[^\\"{}\[\]]++|\\'), F.lit(0))
    none = F.array().cast("array<struct<odd:boolean,goal:int,at:int,end:int>>")
    start = F.struct(F.lit(0).alias("even"), F.lit(0).alias("uneven"), F.lit(False).alias("odd"), F.lit(0).alias("length"), none.alias("heads"))

    def step(acc: Column, x: Column) -> Column:
        opens, escaped, closes = x.isin("{", "["), x.isin("\\{", "\\["), x.isin("}", "]")
        odd, length = acc["odd"], acc["length"] + F.length(x)
        old = F.when(odd, acc["uneven"]).otherwise(acc["even"])
        depth = old + F.when(opens, 1).when(closes, -1).otherwise(0)
        # one behind a backslash is a bracket for itself alone
        head = F.struct(odd.alias("odd"), F.when(escaped, old - 1).otherwise(old).alias("goal"), length.alias("at"), F.lit(0).alias("end"))
        close = lambda h: F.struct(h["odd"].alias("odd"), h["goal"].alias("goal"), h["at"].alias("at"), F.when((h["end"] == 0) & (h["odd"] == odd) & (h["goal"] == depth), length).otherwise(h["end"]).alias("end"))
        heads = F.when((opens | escaped) & (F.size(acc["heads"]) < tries), F.array_append(acc["heads"], head)).when(closes, F.transform(acc["heads"], close)).otherwise(acc["heads"])
        even, uneven = F.when(odd, acc["even"]).otherwise(depth), F.when(odd, depth).otherwise(acc["uneven"])
        return F.struct(even.alias("even"), uneven.alias("uneven"), (odd != (x == '"')).alias("odd"), length.alias("length"), heads.alias("heads"))

    return F.aggregate(parts, start, step)["heads"]


def json_payload(text: Column, key: str | None = None, tries: int = 12) -> Column:
    """The first JSON document in a noisy text, as a string; NULL if none parses.

    Thought blocks and code fences go first; then a document is looked for at each of the first ``tries`` opening brackets
    (as many as the rule has it), whatever stands behind it. With a key, an object without it is passed over; arrays are
    taken. The time is in proportion to the text.
    """
    clean = F.regexp_replace(without_thoughts(text), r"(?i)```(?:json)?", "")

    def document(head: Column) -> Column:
        doc = F.substring(clean, head["at"], head["end"] - head["at"] + 1)
        parsed = F.try_parse_json(doc)
        fits = parsed.isNotNull()
        if key:
            fits &= F.startswith(doc, F.lit("[")) | F.try_variant_get(parsed, f"$.{key}", "variant").isNotNull()
        return F.when(fits, doc)

    closed = F.filter(_documents(clean, tries), lambda head: head["end"] > 0)
    return F.aggregate(closed, F.lit(None).cast("string"), lambda acc, head: F.when(acc.isNotNull(), acc).otherwise(document(head)))


def salvaged_field(raw: Column, name: str) -> Column:
    """A string field of a document that may be cut off: by pattern, not by parsing; NULL if absent."""
    return F.nullif(F.regexp_extract(raw, rf'"{name}"\s*:\s*"((?:[^"\\]|\\.)*)"', 1), F.lit(""))


def salvaged_count(raw: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(raw, rf'"{name}"\s*:\s*"?(-?\d+)', 1), F.lit("")).try_cast("int")


def salvaged_cells(raw: Column) -> Column:
    """The (t, see) cells of a document that may be cut off."""
    pattern = F.lit(r'\{\s*"t"\s*:\s*"?([^",}]+)"?\s*,\s*"see"\s*:\s*"((?:[^"\\]|\\.)*)"')
    return F.filter(
        F.transform(
            F.arrays_zip(F.regexp_extract_all(raw, pattern, F.lit(1)).alias("t"), F.regexp_extract_all(raw, pattern, F.lit(2)).alias("see")),
            lambda x: F.struct(salvaged_number(x["t"]).alias("t"), x["see"].alias("see")),
        ),
        lambda x: x["t"].isNotNull(),
    )


def option_list(value: Column) -> Column:
    """A list given as text with commas or semicolons; blanks are dropped."""
    return F.filter(F.transform(F.split(value, "[,;]"), lambda x: F.trim(x)), lambda x: x != "")


def safe_path(path: Column) -> Column:
    """A relative path that stays where it is: no root, no drive, no parent."""
    return ~path.rlike(r"^([/\\]|[A-Za-z]:)") & ~path.rlike(r"(^|[/\\])\.\.([/\\]|$)") & (path != "")


def out_of_memory(message: Column) -> Column:
    return message.rlike(r"(?i)out of memory|cuda oom|outofmemory|allocation on device")


@F.pandas_udf(T.BooleanType())
def phrase_loop_of_text(texts):
    """``phrase_loop`` in time that grows with the length alone; NULL for NULL."""
    import pandas as pd

    def loops(text):
        if text is None:
            return None
        n = len(text)
        if any(n >= 3 * k and text.count(text[:k]) >= 3 for k in range(8, 21)):
            return True
        if n < 36:
            return False
        seen = {text[i : i + 12]: (0, 0) for i in range(max(1, n // 4))}  # how often, and from where on it counts again
        for i in range(n - 11):
            window = text[i : i + 12]
            if window in seen:
                times, free = seen[window]
                if i >= free:
                    if times == 2:
                        return True
                    seen[window] = (times + 1, i + 12)
        return False

    return pd.Series([loops(t) for t in texts], dtype="object")


def same_title(a: Column, b: Column) -> Column:
    """Equal, one within the other, or a ratio of at least 0.8; plain tests come before the ratio."""
    x, y = bare_title(a), bare_title(b)
    plain = (x == y) | ((x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x)))
    return F.when(plain, True).otherwise(similar(F.when(~plain, a), F.when(~plain, b), 0.8))


def title_of_drama(text: Column, skip: str, bracketed: str = r"[《【「『][^》】」』]{4,30}[》】」』]") -> Column:
    """Whether a line is the title of a story: 4 to 30 characters in brackets, or a superlative of 6 to 28 characters; never
    one that matches ``skip``."""
    raw = trimmed(F.coalesce(text, F.lit("")))
    return (raw != "") & ~raw.rlike(skip) & (raw.rlike(bracketed) | (F.contains(raw, F.lit("最")) & F.length(raw).between(6, 28)))


def aspect_differs(source: Column, wanted: Column) -> Column:
    """Whether two aspect labels differ; one that is missing differs from nothing."""
    return F.coalesce((trimmed(source) != "") & (trimmed(wanted) != "") & (trimmed(source) != trimmed(wanted)), F.lit(False))


def canonical_name(name: Column, aliases: dict[str, str], known: tuple[str, ...]) -> Column:
    """A name under its present form; NULL if it is none of the known ones."""
    now = F.coalesce(F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])[name], name) if aliases else name
    return F.when(now.isin(*known), now)


def topic_list(raw: Column) -> Column:
    """Topics given as a list in JSON, as such a list inside a string of a list, or as plain text; empty ones are left out."""
    listed = lambda c: F.when(F.startswith(c, F.lit("[")), F.from_json(c, "array<string>"))
    text = trimmed(F.coalesce(raw, F.lit("")))
    outer = F.coalesce(listed(text), F.array(text))
    inner = F.when(F.size(outer) == 1, listed(trimmed(F.try_element_at(outer, F.lit(1)))))
    return F.filter(F.transform(F.coalesce(inner, outer), trimmed), lambda t: F.coalesce(t != "", F.lit(False)))


def mentions(message: Column, marks: tuple[str, ...]) -> Column:
    """Whether a message holds one of the marks that tell its kind."""
    return reduce(lambda a, b: a | b, [F.contains(F.coalesce(message, F.lit("")), F.lit(m)) for m in marks])


def light(ok: Column, needed: Column) -> Column:
    """ok, red for what is needed and isn't, yellow for what isn't needed."""
    return F.when(ok, "ok").when(needed, "red").otherwise("yellow")


def plain_message(message: Column, most: int = 800) -> Column:
    """A message without its traceback, at most so many characters; the last one tells that there was more."""
    raw = trimmed(F.substring_index(F.coalesce(message, F.lit("")), "\nTraceback", 1))
    return F.when(F.length(raw) > most, F.concat(F.substring(raw, 1, most - 1), F.lit("…"))).otherwise(raw)


def mail_error(message: Column, code: Column) -> Column:
    """The kind of a mail server's error: a login that was refused, a connection that closed, or the message itself."""
    text = trimmed(F.coalesce(message, F.lit("")))
    return F.when((F.coalesce(code, F.lit(0)) == 535) | F.contains(text, F.lit("535")) | F.contains(text, F.lit("Login fail")), F.concat(F.lit("login refused (535): "), text)).when(F.contains(F.lower(text), F.lit("unexpectedly closed")), "connection closed during login").otherwise(text)


def made_by_another(segments: Column, made: Column, wanted: Column) -> Column:
    """Whether a transcript is out of date: it has no segments, or the name of the wanted model isn't in what made it."""
    short = F.lower(F.substring_index(wanted, "/", -1))
    return (F.coalesce(F.size(segments), F.lit(0)) <= 0) | ~F.contains(F.lower(F.coalesce(made, F.lit(""))), short)


def page_ready(title: Column, body: Column, detail: Column, videos: Column, failed: str, loading: str, shells: tuple[str, ...]) -> Column:
    """Whether a page has loaded: with its detail or its error it has; while it says that it loads it hasn't; else it has a
    title, and without a video one that isn't the empty shell's."""
    name, text = trimmed(F.coalesce(title, F.lit(""))), F.coalesce(body, F.lit(""))
    return F.when(detail.isNotNull() | F.contains(text, F.lit(failed)), True).when(F.contains(text, F.lit(loading)), False).when(F.coalesce(videos, F.lit(0)) > 0, name != "").otherwise((name != "") & ~name.isin(*shells))


def without_prefixes(name: Column, prefixes: tuple[str, ...]) -> Column:
    """A name without any of the prefixes, however many stand in front."""
    return F.regexp_replace(name, "^(?:" + "|".join(p.replace(".", r"\.") for p in prefixes) + ")+", "")
