"""Text functions as column expressions; all of them stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WHITE = r"[ \t\n\r\f\x0B]+"

# Word lists of the query analysis and of full-text search.
TERM_STOP_WORDS = "a an and are at did do for from in is of on or the to what when where which who with".split()
ENTITY_CUES = "for about did does with from".split()
NAME_FOLLOWERS = "moved move owns owned launch launched".split()
ENTITY_NOISE = "city date owner owns launch public project beta deployment readiness timeline status updates update report checklist signoff team health allergic".split()
SEARCH_STOP_WORDS = (
    "a an the i me my we our you your he she it they its his her them their is am are was were be been being do does did has have had having "
    "will would shall should can could may might must in on at to for of with by from up about into through during before after above below between under over "
    "and but or nor not so yet what which who whom when where why how this that these those there here all each every both few more most other some such no only own same than too very just also then"
).split()
MONTHS = "january february march april may june july august september october november december".split()
LOCATION, DATE, OWNERSHIP, MULTI_HOP = 1, 2, 4, 8
INTENT_WORDS = {LOCATION: ("city", "where", "mov"), DATE: ("date", "when", "launch", "timeline"), OWNERSHIP: ("who", "owner", "owns", "deployment readiness")}
TEMPORAL_WORDS = ("when", "yesterday", "today", "last ", "recent", "latest", "before ", "after ", "between ")
FACTUAL_STARTS, FACTUAL_WORDS = ("what is", "what are", "who is", "who are"), ("define ", "definition of", "meaning of")
SEMANTIC_WORDS = ("how ", "why ", "explain", "describe", "relate")
TENTATIVE = ("tentative", "draft", "proposed", "pending approval", "target is", "target date", "could be", "estimate")
DISTRACTORS = ("weekly report", "checklist", "signoff", "allergic", "distractor", "draft memo", "tentative", "pending approval")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def contains_any(text: Column, needles: tuple[str, ...] | list[str]) -> Column:
    return any_of([F.contains(text, F.lit(n)) for n in needles])


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return F.filter(F.split(text, WHITE), lambda w: w != "")


def lower_words(text: Column) -> Column:
    return words(ascii_lower(text))


def literal_array(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def first_words(text: Column, n: int) -> Column:
    return F.array_join(F.slice(words(text), 1, n), " ")


def truncate_bytes(text: Column, n: int) -> Column:
    """The first n bytes; a character that is cut becomes the replacement character."""
    return F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), 1, n).cast("string")) if n > 0 else F.lit("")


def stem(word: Column) -> Column:
    n = F.length(word)
    return (
        F.when((n > 3) & F.endswith(word, F.lit("ies")), F.concat(F.left(word, n - 3), F.lit("y")))
        .when((n > 3) & F.endswith(word, F.lit("ing")), F.left(word, n - 3))
        .when((n > 2) & F.endswith(word, F.lit("ed")), F.left(word, n - 2))
        .when((n > 2) & F.endswith(word, F.lit("s")), F.left(word, n - 1))
        .otherwise(word)
    )


def normalized_terms(text: Column) -> Column:
    """Lower-case words without stop words, stemmed, repeats kept."""
    return F.transform(F.filter(lower_words(text), lambda w: ~w.isin(TERM_STOP_WORDS)), stem)


def entity_terms(text: Column) -> Column:
    """Words that mix letters and digits, and words behind a cue; sorted and distinct."""
    start = F.struct(F.array().cast("array<string>").alias("found"), F.lit(False).alias("cued"), F.lit("").alias("before"))

    def step(state: Column, w: Column) -> Column:
        mixed = w.rlike("[a-z]") & w.rlike("[0-9]")
        cue = ~mixed & w.isin(ENTITY_CUES)
        plain = ~w.isin(TERM_STOP_WORDS) & ~w.isin(ENTITY_NOISE)
        take = mixed | (~cue & plain & (state["before"].isin(NAME_FOLLOWERS) | state["cued"]))
        return F.struct(F.when(take, F.array_append(state["found"], w)).otherwise(state["found"]).alias("found"), cue.alias("cued"), w.alias("before"))

    return F.array_sort(F.array_distinct(F.aggregate(lower_words(text), start, step, lambda s: s["found"])))


def year_terms(text: Column) -> Column:
    """Distinct years 1900 to 2099 that stand alone, sorted."""
    runs = F.regexp_extract_all(text, F.lit("[0-9A-Za-z]+"), F.lit(0))
    return F.array_sort(F.array_distinct(F.filter(runs, lambda r: r.rlike("^(19|20)[0-9]{2}$"))))


ISO_DATE = r"\b(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})\b"


def date_keys(text: Column) -> Column:
    """ISO-like dates as YYYY-MM-DD, distinct and sorted."""
    parts = F.transform(F.regexp_extract_all(text, F.lit(ISO_DATE), F.lit(0)), lambda d: F.split(d, "[-/.]"))
    good = F.filter(parts, lambda p: p[1].cast("int").between(1, 12) & p[2].cast("int").between(1, 31))
    return F.array_sort(F.array_distinct(F.transform(good, lambda p: F.concat_ws("-", p[0], F.lpad(p[1], 2, "0"), F.lpad(p[2], 2, "0")))))


_BLANK = r"[ \t\n\r\f\x0B]*"


def _written_date(name: str) -> str:
    first = rf"(?<![A-Za-z])(?i:{name}){_BLANK}\d{{1,2}}(?!\d),?{_BLANK}\d{{4}}(?!\d)"
    return rf"{first}|(?<!\d)\d{{1,2}}{_BLANK}(?i:{name}){_BLANK}\d{{4}}(?!\d)"


def has_date_literal(text: Column) -> Column:
    """True if ``date_literals`` finds any; one pattern, so far cheaper."""
    return text.rlike(_written_date("|".join(x for m in MONTHS for x in (m, m[:3]))) + "|" + ISO_DATE)


def date_literals(text: Column) -> Column:
    """Written dates, month by month (full names before short ones), then ISO-like ones, as they stand in the text.

    May has no short name of its own, so its dates are listed twice.
    """
    found = [F.regexp_extract_all(text, F.lit(_written_date(name)), F.lit(0)) for month in MONTHS for name in (month, month[:3])]
    found.append(F.regexp_extract_all(text, F.lit(ISO_DATE), F.lit(0)))
    return F.when(has_date_literal(text), F.flatten(F.array(*found))).otherwise(F.array().cast("array<string>"))


def has_quoted_phrase(text: Column) -> Column:
    """True if a pair of double quotes, taken from the left, has something between."""
    parts = F.split(text, '"')
    inside = F.filter(F.transform(parts, lambda p, i: F.struct(p.alias("p"), i.alias("i"))), lambda s: (s["i"] % 2 == 1) & (s["i"] < F.size(parts) - 1) & (s["p"] != ""))
    return F.size(inside) > 0


def specificity(query: Column) -> Column:
    score = F.least(F.size(words(query)) / 8.0, F.lit(0.4)) + F.when(F.size(entity_terms(query)) > 0, 0.35).otherwise(0.0) + F.when(has_quoted_phrase(query), 0.25).otherwise(0.0)
    return F.least(score, F.lit(1.0))


def intent(query: Column) -> Column:
    """Bit mask of what is asked for; several hops need `` and `` and two kinds."""
    low = ascii_lower(query)
    kinds = {bit: contains_any(low, needles) for bit, needles in INTENT_WORDS.items()}
    asked = sum((F.when(c, 1).otherwise(0) for c in kinds.values()), F.lit(0))
    mask = sum((F.when(c, bit).otherwise(0) for bit, c in kinds.items()), F.lit(0))
    return mask + F.when(F.contains(low, F.lit(" and ")) & (asked >= 2), MULTI_HOP).otherwise(0)


def query_class(query: Column) -> Column:
    low = ascii_lower(query)
    factual = any_of([F.startswith(low, F.lit(s)) for s in FACTUAL_STARTS]) | contains_any(low, FACTUAL_WORDS)
    return F.when(contains_any(low, TEMPORAL_WORDS), "temporal").when(factual, "factual").when(contains_any(low, SEMANTIC_WORDS), "semantic").otherwise("exploratory")


def is_tentative(text: Column) -> Column:
    return contains_any(text, TENTATIVE)


def is_distractor(text: Column) -> Column:
    return contains_any(text, DISTRACTORS)


def moved_to_place(text: Column) -> Column:
    return text.rlike("(moved|move) to [A-Z][a-z]+")


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"[.!?\n]"), lambda s: F.trim(F.regexp_replace(s, r"^[ \t\r\f\x0B]+|[ \t\r\f\x0B]+$", ""))), lambda s: s != "")


def clean_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(text, "[]", ""), WHITE, " "))


def token_estimate(text: Column) -> Column:
    """A quarter of the bytes, rounded up; nothing has none."""
    return F.ceil(F.octet_length(text) / 4).cast("bigint")


def prompt_tokens(text: Column) -> Column:
    """Words, and each sign of punctuation by itself."""
    return F.size(F.regexp_extract_all(text, F.lit(r"[!-/:-@\[-`{-~]|[^\s!-/:-@\[-`{-~]+"), F.lit(0)))


def json_tokens(text: Column) -> Column:
    """One, and one for each step from a word to a separator."""
    return F.regexp_count(text, F.lit(r"[^\s{}\[\],:\"][\s{}\[\],:\"]")) + 1


def flag(value: Column) -> Column:
    return F.coalesce(ascii_lower(value).isin("1", "true", "yes", "on"), F.lit(False))


def short_path(path: Column) -> Column:
    """What follows the last dot, or else the last slash; a path that ends with its separator stays."""
    dot, slash = F.substring_index(path, ".", -1), F.substring_index(path, "/", -1)
    return F.when(F.contains(path, F.lit(".")) & (dot != ""), dot).when(F.contains(path, F.lit("/")) & (slash != ""), slash).otherwise(path)


#: Languages by file extension.
LANGUAGES = {"h": "cpp", "hpp": "cpp", "cpp": "cpp", "inl": "cpp", "inc": "cpp", "cc": "cpp", "c": "c", "py": "python", "js": "javascript", "json": "json", "bpl_json": "blueprint", "cs": "csharp", "md": "markdown"}


def extension(path: Column) -> Column:
    return ascii_lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def language_of(path: Column) -> Column:
    ext = extension(path)
    out = F.lit("text")
    for e, name in LANGUAGES.items():
        out = F.when(ext == e, name).otherwise(out)
    return out
