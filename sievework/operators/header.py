"""The head of a manuscript: notes before it, title, author block, names and affiliations.

Every line is described once, by counts and flags (`describe`): how many words and how many of them are
capitalised, glue, single letters; whether it speaks of publishing, a meeting, a date, a venue, an organisation, a
place; how many of its parts could be persons. Steps then choose among described lines: the notes are the
front stretch of greatest weight, the title is the first line that is nothing else, the author block ends at
the first section line. `headers` does this in columns, one step after the other, so a pattern stands in the plan once.

White space is Unicode's, no-break spaces included. Positions count from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .structuring import let

SPACE = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
LATIN = r"\x{41}-\x{5a}\x{61}-\x{7a}\x{c0}-\x{24f}"
RTL = r"[\x{0590}-\x{08ff}]"
MARKS = "∗*†‡§¶○●"

#: Vocabularies of a line's features, in lower case.
GLUE = (
    "a", "an", "and", "as", "at", "by", "for", "from", "in", "into", "of", "on", "or", "over", "the", "to", "under", "using",
    "via", "with", "without", "against", "across", "toward", "towards", "between", "among", "during", "than", "that", "which",
    "whose", "when", "where", "while", "because", "but", "nor", "so", "yet", "is", "are", "be",
)
LIST_TYPES = (
    "research", "original", "review", "short", "brief", "technical", "case", "news", "editorial", "perspective", "commentary",
    "letter", "rapid", "systematic", "invited", "survey", "method", "methods", "article", "articles", "report", "reports",
    "communication", "communications", "note", "notes", "paper", "papers", "correspondence",
)
VENUES = (
    "journal", "frontiers", "annals", "proceedings", "transactions", "letters", "reviews", "bulletin", "archives", "acta",
)
MEETINGS = (
    "conference", "congress", "symposium", "workshop", "forum", "summit", "seminar", "meeting",
)
SCOPES = (
    "international", "national", "annual", "world", "global", "regional", "ieee", "acm", "ifac", "ifip", "european", "asian",
    "american",
)
ORGANISATIONS = (
    "university", "universities", "institute", "college", "hospital", "laboratory", "laboratories", "department", "dept",
    "school", "center", "centre", "faculty", "academy", "division", "ministry",
)
COMPANIES = (
    "inc", "corp", "corporation", "co", "ltd", "llc", "gmbh", "pty", "pte", "technology", "technologies", "group", "holdings",
    "foundation", "research", "labs", "lab", "brain", "ai",
)
HOUSES = (
    "google", "deepmind", "microsoft", "facebook", "meta", "amazon", "apple", "nvidia", "ibm", "intel", "huawei", "tencent",
    "alibaba", "baidu", "samsung",
)
PLACES = (
    "china", "usa", "uk", "japan", "korea", "singapore", "thailand", "india", "taiwan", "germany", "france", "italy", "spain",
    "canada", "australia", "belgium", "netherlands", "switzerland", "beijing", "shanghai", "hong", "kong", "tokyo", "seoul",
    "bangkok", "london", "paris", "boston", "united", "states", "kingdom",
)
STREETS = (
    "road", "rd", "street", "avenue", "ave", "boulevard", "blvd", "lane", "campus",
)
PARTICLES = (
    "van", "von", "der", "den", "de", "del", "della", "di", "da", "dos", "du", "la", "le", "bin", "ibn", "al", "el", "y", "ter",
)
MONTHS = (
    "jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec",
)
#: What publishers' notes speak of.
NOTICES = (
    "copyright", "©", "all rights reserved", "permission", "hereby grants?", "licen[cs]ed? under", "creative commons", "open access", "reuse guidelines", "peer-?review", "under review", "in press", "preprint", "arxiv",
    "published by", "available online", "elsevier", "science ?direct", "sagepub", "procedia", "resource cent(?:re|er)", "corresponding author", "e-?mail address", "covid-19 (?:research|resource)", r"https?://", r"www\.", r"^doi\b", r"^10\.\d{4,9}/", r"^\d{4}-\d{3}[\dX]\b",
)
#: Heads of what a publisher puts before the paper, and sections that end an author block, without their spaces.
FRONT_HEADS = ("highlights", "highlight", "graphicalabstract", "graphical-abstract", "articleinfo", "articleinformation", "articlehistory")
SECTIONS = ("abstract", "keywords", "keyword", "introduction", "摘要", "关键词", "引言", *FRONT_HEADS)
BULLET = r"^[•◦▪●○■□–—\-*]" + SPACE


def _one_of(words: list[str] | tuple[str, ...]) -> str:
    return "(?:" + "|".join(words) + ")"


_NOTICE = "(?i)(?<![a-z])" + _one_of(NOTICES)
_MEETING = rf"(?i)\b{_one_of(SCOPES)}\b.*\b{_one_of(MEETINGS)}\b|^(?:the )?\d+ ?(?:st|nd|rd|th)\b.*\b{_one_of(MEETINGS)}\b|^\((?-i:[A-Z])[\w\- ]+ (?:19|20)\d\d\)$"
_DATE = rf"(?i)^{_one_of(MONTHS)}[a-z]*\.? \d{{1,2}}\b.*\b(?:19|20)\d\d\b|^(?:(?:19|20)\d\d[,.]? )?(?:vol(?:ume)?|no|issue|pp?)\b\.? ?\d"
_VENUE = rf"(?i)^(?:{_one_of(SCOPES)} )?{_one_of(VENUES)} (?:of|in|on)\b"
_SECTION = rf"(?i)^(?:abstract|introduction|摘要|引言)[ :：.\-]+\S|^keywords? ?[:：]|^(?-i:\d+\.? [A-Z][a-z])|^(?:received|accepted|published|available online|first published|manuscript received|article history|address correspondence|correspondence)\b|(?:©|\(c\)) ?\d{{4}}"
_ORGANISATION = rf"(?i)\b{_one_of(ORGANISATIONS)}\b|大学|学院|医院|研究所|研究院|实验室"
_COMPANY = rf"(?i)\b{_one_of(COMPANIES)}\b\.?"
_ADDRESS = rf"(?i)\b{_one_of([*PLACES, *STREETS])}\b"
_NAME_PART = rf"^(?:\p{{Lu}}[\p{{L}}'’.\-]*|{_one_of(PARTICLES)})$"
_PREFIX = r"^([a-z]|\d{1,2}) ?(?=\p{Lu})"


def folded(line: Column) -> Column:
    """White space of any kind as one space, none at the ends."""
    return F.trim(F.regexp_replace(line, SPACE + "+", " "))


def words(line: Column) -> Column:
    return F.array_remove(F.split(line, " "), "")


def _count(tokens: Column, pattern: str) -> Column:
    return F.size(F.filter(tokens, lambda w: w.rlike(pattern)))


def first_where(flags: Column, start: Column | int = 0) -> Column:
    """The first place, from `start` on, of an array of booleans that is true; -1 if none is."""
    begin = F.lit(start) if isinstance(start, int) else start
    places = F.filter(F.transform(flags, lambda flag, i: F.when(flag & (i >= begin), i)), lambda i: i.isNotNull())
    return F.coalesce(F.try_element_at(places, F.lit(1)), F.lit(-1)).cast("int")


def _from(lines: Column, start: Column) -> Column:
    return let(start, lambda at: F.slice(lines, at + 1, F.greatest(F.size(lines) - at, F.lit(0))))


def header_lines(pages: Column, text: Column, most: int = 8000) -> Column:
    """The lines of the first two pages, or of the first characters if there are no pages, folded; none is empty."""
    head = F.when(F.size(pages) > 0, F.array_join(F.slice(pages, 1, 2), "\n")).otherwise(F.left(text, F.lit(most)))
    return F.filter(F.transform(F.split(head, r"[\r\n\x{85}\x{2028}\x{2029}]+"), folded), lambda x: x != "")


# --- lines ---------------------------------------------------------------------------------------------


def person_like(part: Column) -> Column:
    """Could this be a person's name? Two to six words, all capitalised or particles, of no organisation or place; or a Han name."""

    def told(bare: Column) -> Column:
        def named(tokens: Column) -> Column:
            known = F.arrays_overlap(F.transform(tokens, lambda w: F.lower(F.regexp_replace(w, r"[.,]+$", ""))), F.array(*(F.lit(w) for w in [*HOUSES, *COMPANIES, *PLACES, *ORGANISATIONS])))
            own = F.size(tokens).between(2, 6) & F.forall(tokens, lambda w: w.rlike(_NAME_PART)) & (_count(tokens, r"^\p{Lu}.*\p{L}") >= 1) & ~bare.rlike(r"\p{Ll}\. \p{Lu}")
            return (own | bare.rlike(r"^[\x{4e00}-\x{9fff}·]{3,8}$")) & ~known & ~bare.rlike("[?!:]")

        return F.length(bare).between(3, 80) & let(words(F.regexp_replace(bare, r"[.,;:!?]+$", "")), named)

    return let(F.trim(F.regexp_replace(part, rf"(?: [a-e])?[\d{MARKS}, ]*$", "")), told)


def segments(line: Column) -> Column:
    """The parts of a byline: between commas, semicolons, dots in the middle and conjunctions; four or more capitalised words in a row are names of two."""

    def pairs(part: Column) -> Column:
        def cut(tokens: Column) -> Column:
            bare = F.transform(tokens, lambda w: F.regexp_replace(w, rf"[\d{MARKS}]+$", ""))
            row = (F.size(tokens) > 3) & (F.size(tokens) % 2 == 0) & F.forall(bare, lambda w: w.rlike(r"^\p{Lu}\p{Ll}"))
            two = let(bare, lambda own: F.transform(F.sequence(F.lit(1), F.greatest(F.size(own), F.lit(1)), F.lit(2)), lambda i: F.array_join(F.slice(own, i, 2), " ")))
            return F.when(row, two).otherwise(F.array(part))

        return let(words(part), cut)

    parts = F.split(line, r" ?[,;；·、] ?| (?i:and) (?=\p{Lu})| & ")
    return F.flatten(F.transform(F.filter(parts, lambda x: ~x.rlike(rf"^[\d{MARKS} ]*$")), pairs))


def describe(lines: Column) -> Column:
    """array<struct> of the lines' features: x (the line), n words, and flags; `kind` names what a line is, "text" if nothing else.

    A line is cut into words once. Its parts, and the persons among them, are only looked for where nothing cheaper settles the kind.
    """

    def told(s: Column) -> Column:
        x, tokens = s["x"], s["tokens"]
        squeezed = x
        for mark in " :：.":
            squeezed = F.replace(squeezed, F.lit(mark), F.lit(""))
        return F.struct(
            x.alias("x"), tokens.alias("tokens"), s["low"].alias("low"), F.size(tokens).alias("n"), F.length(x).alias("size"), F.regexp_count(x, F.lit(r"(?<![^ ])\p{Lu}")).alias("capitals"),
            F.size(F.filter(s["low"], lambda w: w.isin(*GLUE))).alias("glue"), F.lower(squeezed).alias("squeezed"), F.regexp_count(x, F.lit(r"[\x{3400}-\x{9fff}]")).alias("han"),
        )

    def named(s: Column) -> Column:
        x, n = s["x"], s["n"]
        capital_rest = s["capitals"] + s["glue"] >= n
        body = F.regexp_replace(x, _PREFIX, "")
        placed = body.rlike(_ORGANISATION) | x.rlike(_PREFIX) & (body.rlike(_COMPANY) | body.rlike(_ADDRESS) | (F.regexp_count(x, F.lit(",")) >= 2))
        marked = x.rlike(rf"[{MARKS}]|\p{{L}}\d") | x.rlike(r", | and \p{Lu}| & ")
        singles = F.size(F.filter(s["tokens"], lambda w: F.length(w) == 1))

        def counted(parts: Column) -> Column:
            persons = F.when((s["glue"] <= F.size(parts)) | (n <= 4), F.size(F.filter(parts, person_like))).otherwise(0)
            return F.struct(F.size(parts).alias("parts"), persons.alias("persons"))

        def rest(c: Column) -> Column:
            some = c["persons"] >= 1
            return (
                F.when(some & (2 * c["persons"] >= c["parts"]) & (s["glue"] <= c["parts"]) & (s["size"] <= 400) & marked, "names")
                .when(((n < 8) | x.rlike(_PREFIX)) & placed, "place")
                .when(some & (c["persons"] == c["parts"]) & (n <= 4), "name?").otherwise("text")
            )

        byline = F.when((n <= 4) | (s["size"] <= 400) & marked, let(segments(x), counted))
        kind = (
            F.when((n >= 4) & (singles >= 0.6 * n) & ~s["squeezed"].isin(*SECTIONS), "spaced")
            .when(s["squeezed"].isin(*FRONT_HEADS), "front").when(s["squeezed"].isin(*SECTIONS) | x.rlike(_SECTION), "section")
            .when((n <= 3) & F.forall(s["low"], lambda w: w.isin(*LIST_TYPES)), "type").when(x.rlike(_MEETING), "meeting").when(x.rlike(_DATE), "date")
            .when((n <= 9) & capital_rest & ~x.contains(":") & x.rlike(_VENUE), "venue").when(x.rlike(_NOTICE), "notice").when(x.rlike(BULLET), "bullet").when(x.contains("@"), "mail")
            .otherwise(let(byline, rest))
        )
        return F.struct(*(s[c].alias(c) for c in ("x", "n", "size", "capitals", "glue", "han")), kind.alias("kind"))

    cut = F.transform(lines, lambda x: F.struct(x.alias("x"), words(x).alias("tokens"), words(F.lower(x)).alias("low")))
    return F.transform(F.transform(cut, told), named)


_GLUE_END = rf"(?i)(?:\b{_one_of(GLUE)}|[,/\-–:])$"


def settle_kinds(lines: Column) -> Column:
    """Kinds that follow from the line before: what goes on with a meeting, and a lone word or two after a venue's open end."""

    def seen(own: Column, x: Column, i: Column) -> Column:
        before = F.when(i > 0, F.try_element_at(own, F.greatest(i, F.lit(1))))
        open_ = before["x"].rlike(_GLUE_END) | x["x"].rlike(rf"^{_one_of(GLUE)}\b|^\p{{Ll}}") | x["x"].rlike(r"^\W*(?:19|20)\d\d\W*$")
        kind = F.when((before["kind"] == "meeting") & (x["kind"].isin("text", "name?", "names")) & open_, "meeting").when((before["kind"] == "venue") & before["x"].rlike(_GLUE_END) & (x["n"] <= 4), "venue").otherwise(x["kind"])
        return F.struct(*(x[c].alias(c) for c in ("x", "n", "size", "capitals", "glue", "han")), kind.alias("kind"))

    once = lambda own: F.transform(own, lambda x, i: seen(own, x, i))
    return let(let(lines, once), once)


# --- preamble --------------------------------------------------------------------------------------------


def preamble_size(lines: Column, most: int = 200) -> Column:
    """How many lines before the paper are notes (`lines` described).

    A note weighs 2, a line in small letters that follows 1, any other -3; the front stretch of the greatest
    total goes if it holds three notes or more. Where highlights or the like come first of all, what goes reaches
    to the last of their bullets, and the lines that go on with it.
    """
    noted = F.transform(F.slice(lines, 1, most), lambda x: F.when(x["kind"].isin("notice", "meeting", "date", "venue"), 2).when(x["x"].rlike(r"^\p{Ll}|^[\p{L}]{1,3}$"), 1).otherwise(-3))
    start = F.struct(*(F.lit(0).alias(c) for c in ("at", "sum", "best", "end", "notes", "held")))

    def step(s: Column, w: Column) -> Column:
        total, notes = s["sum"] + w, s["notes"] + (w == 2).cast("int")
        best = total > s["best"]
        return F.struct((s["at"] + 1).alias("at"), total.alias("sum"), F.when(best, total).otherwise(s["best"]).alias("best"), F.when(best, s["at"] + 1).otherwise(s["end"]).alias("end"), notes.alias("notes"), F.when(best, notes).otherwise(s["held"]).alias("held"))

    notes = F.aggregate(noted, start, step, lambda s: F.when(s["held"] >= 3, s["end"]).otherwise(0))

    def fronted(own: Column, begin: Column) -> Column:
        ahead = F.slice(own, begin + 1, 40)
        head = first_where(F.transform(F.slice(ahead, 1, 30), lambda x: x["kind"] == "front"))
        early = first_where(F.transform(ahead, lambda x: (x["n"] >= 2) & x["kind"].isin("text", "name?", "names")))

        def after(h: Column) -> Column:
            bullets = F.transform(ahead, lambda x: x["kind"] == "bullet")
            last = F.array_max(F.transform(bullets, lambda b, i: F.when(b, i).otherwise(-1)))
            goes_on = F.transform(ahead, lambda x: x["x"].rlike(r"^\p{Ll}(?!\p{Lu}| \p{Lu})"))
            wrapped = F.array_max(F.transform(goes_on, lambda g, i: F.when(g & (i > h), i).otherwise(-1)))
            since = F.when(last >= 0, last).otherwise(F.when(F.coalesce(wrapped, F.lit(-1)) > h, wrapped - 1).otherwise(h))
            end = first_where(F.transform(goes_on, lambda g: ~g), since + 1)
            kept = first_where(F.transform(ahead, lambda x: (x["n"] >= 2) & x["kind"].isin("text", "name?", "names")), end)
            return F.when((h < 0) | (early >= 0) & (early < h) | (end < 0) | (kept < 0), begin).otherwise(begin + kept)

        return let(head, after)

    return let(notes, lambda begin: fronted(lines, begin))


def strip_preamble(lines: Column) -> Column:
    """Plain lines without the notes before the paper."""
    return F.transform(stripped(describe(lines)), lambda x: x["x"])


def stripped(lines: Column) -> Column:
    """Described lines without the notes before the paper; kinds that follow from the line before are not settled."""
    return let(lines, lambda own: _from(own, preamble_size(settle_kinds(own))))


# --- title --------------------------------------------------------------------------------------------------


def _title_like(x: Column) -> Column:
    small = x["x"].rlike(r"^\p{Ll}(?!\p{Ll}* ?\p{Lu})")
    words_ = (x["n"] >= 2) & ~small & (x["capitals"] + x["glue"] > 0)
    return x["kind"].isin("text", "name?") & x["size"].between(6, 250) & (words_ | (x["han"] >= 4) & (2 * x["han"] >= x["size"]))


def _bare(line: Column) -> Column:
    """Without the number of a footnote at its end."""
    return F.trim(F.regexp_replace(line, r"(?<=\p{Ll})\d{1,2}$", ""))


def title_of(lines: Column, horizon: int = 25) -> Column:
    """array<struct<title, first, last>> of one title, or none: the first line within the horizon that is like one, and up to three that go on with it."""
    at = lambda own, i: F.try_element_at(own, i + 1)

    def goes_on(own: Column, s: Column) -> Column:
        i = s["last"] + 1
        x, after = at(own, i), at(own, i + 1)
        title, text = s["title"], x["x"]
        cased = 10 * F.size(F.filter(words(title), lambda w: w.rlike(r"^[^\p{Ll}]"))) >= 6 * F.size(words(title))
        # A word or two with capitals is a name, but for titles in capitals whose byline is still to come.
        name = (x["kind"] == "name?") & ~(cased & F.coalesce(after["kind"].isin("names", "name?"), F.lit(False)))
        open_ = title.rlike(_GLUE_END) | text.rlike(rf"^(?i:{_one_of(GLUE)})\b|^\p{{Ll}}")
        closed = title.rlike(r"[.!]$") | title.endswith("?") & text.endswith("?")
        full = (F.size(words(title)) >= 4) | (F.length(title) >= 18)
        plain = x["kind"].isin("text", "name?") | (x["kind"] == "names") & title.rlike(_GLUE_END) & ~text.contains(",")
        return F.coalesce(plain & ~name & (x["size"] <= 120) & (open_ | ~closed & full & (x["n"] <= 12)), F.lit(False))

    def joined(own: Column, s: Column) -> Column:
        more = _bare(at(own, s["last"] + 1)["x"])
        hyphen = s["title"].rlike(r"\p{Ll}-$") & more.rlike(r"^\p{Ll}")
        text = F.when(hyphen, F.concat(F.regexp_replace(s["title"], "-$", ""), more)).otherwise(F.concat_ws(" ", s["title"], more))
        longer = F.struct(text.alias("title"), s["first"].alias("first"), (s["last"] + 1).alias("last"), F.lit(True).alias("open"))
        same = F.struct(s["title"].alias("title"), s["first"].alias("first"), s["last"].alias("last"), F.lit(False).alias("open"))
        return F.when(s["open"] & goes_on(own, s) & (F.length(text) <= 250), longer).otherwise(same)

    def told(own: Column) -> Column:
        def begun(i: Column) -> Column:
            start = F.struct(_bare(at(own, i)["x"]).alias("title"), i.alias("first"), i.alias("last"), F.lit(True).alias("open"))
            step = lambda s: joined(own, s)
            whole = let(let(let(start, step), step), step)
            done = let(whole, lambda s: F.struct(*(s[c].alias(c) for c in ("title", "first", "last"))))
            return F.when(i >= 0, F.array(done)).otherwise(F.array().cast("array<struct<title: string, first: int, last: int>>"))

        return let(first_where(F.transform(F.slice(own, 1, horizon), _title_like)), begun)

    return let(lines, told)


def title_range(lines: Column, horizon: int = 25) -> Column:
    """`title_of` plain lines."""
    return title_of(settle_kinds(describe(lines)), horizon)


# --- authors -----------------------------------------------------------------------------------------------


def author_block(lines: Column, title: Column, most: int = 15) -> Column:
    """The plain lines after the title (of `title_range`) up to a section; the first ones if there is no title."""
    return let(title, lambda told: _block_after(lines, told, most))


def _block_after(lines: Column, title: Column, most: int) -> Column:
    begin = F.when(F.size(title) > 0, F.coalesce(F.get(title, F.lit(0))["last"], F.lit(-1)) + 1).otherwise(0)
    after = F.slice(lines, begin + 1, most)

    def cut(own: Column) -> Column:
        ends = F.transform(own, lambda x: x.rlike(_SECTION) | F.lower(F.regexp_replace(x, r"[ :：.]", "")).isin(*SECTIONS))
        return let(first_where(ends), lambda at: F.when((at >= 0) & (F.size(title) > 0), F.slice(own, 1, at)).otherwise(own))

    return let(after, cut)


def affiliations(block: Column) -> Column:
    """array<struct<mark, body>>: the lines of a block that are affiliations, with the mark that they begin with ('' if none)."""

    def told(x: Column) -> Column:
        return F.struct(x.alias("x"), F.regexp_extract(x, _PREFIX, 1).alias("mark"), F.regexp_replace(F.regexp_replace(x, _PREFIX, ""), r"^[,; ]+", "").alias("body"))

    def placed(s: Column) -> Column:
        return s["body"].rlike(_ORGANISATION) | (s["mark"] != "") & (s["body"].rlike(_COMPANY) | s["body"].rlike(_ADDRESS) | (F.regexp_count(s["x"], F.lit(",")) >= 2))

    return F.transform(F.filter(F.transform(block, told), placed), lambda s: F.struct(s["mark"].alias("mark"), s["body"].alias("body")))


def unmarked(name: Column, letters: Column | None = None) -> Column:
    """struct<base, marks>: a name without its footnote marks, and the marks.

    A letter at the end is a mark if it is one of `letters` (an array: those of the block's affiliations); where
    nothing is known of them, if it is one of a to d and two letters or more of the word remain.
    """
    known = lambda x: x.isin("a", "b", "c", "d") if letters is None else F.array_contains(letters, x)
    tail = rf"(?:[ ,]*\d{{1,2}})*[ ,]*[{MARKS}]*[ ,;]*$"

    def numbers(x: Column) -> Column:
        marks = F.regexp_extract_all(F.regexp_extract(x, f"({tail})", 1), F.lit(rf"(\d{{1,2}}|[{MARKS}])"), F.lit(1))
        return F.struct(F.trim(F.regexp_replace(x, tail, "")).alias("base"), marks.alias("marks"))

    def letter(s: Column) -> Column:
        pattern = r"^(.*\p{L}[\p{L}.]* \p{Lu}\S*?\p{L}|.*\p{L} \p{Lu}\S* |.* \p{Lu}\p{L})([a-z])$"
        last = F.regexp_extract(s["base"], pattern, 2)
        found = (last != "") & known(last)
        return F.struct(F.when(found, F.trim(F.regexp_extract(s["base"], pattern, 1))).otherwise(s["base"]).alias("base"), F.when(found, F.concat(s["marks"], F.array(last))).otherwise(s["marks"]).alias("marks"))

    return let(let(folded(name), numbers), letter)


def author_names(block: Column) -> Column:
    """The names of an author block of plain lines, marks and all, in order."""
    none = F.array().cast("array<string>")

    def told(x: Column) -> Column:
        letters = F.regexp_replace(x, r"[\P{L}]", "")
        right_to_left = (F.length(letters) >= 4) & (F.regexp_count(letters, F.lit(RTL)) >= 0.4 * F.length(letters))
        foreign = F.filter(F.transform(F.split(x, r"[,;،؛]| و | ו "), lambda s: F.trim(s)), lambda s: (F.regexp_count(s, F.lit(RTL)) >= 4) & F.length(s).between(3, 80) & (F.size(words(s)) <= 6))
        body = F.regexp_replace(x, _PREFIX, "")
        place = x.rlike(_PREFIX) & (body.rlike(_ORGANISATION) | body.rlike(_COMPANY) | body.rlike(_ADDRESS) | (F.regexp_count(x, F.lit(",")) >= 2)) | x.rlike(_ORGANISATION)
        use = F.length(x).between(3, 400) & ~x.rlike(rf"@|^\d|^\(|{BULLET}|(?i)https?://|^doi\b|\.\.$") & ~place & ~x.rlike(_NOTICE)
        return F.when(use & right_to_left, foreign).when(use, F.filter(segments(x), person_like)).otherwise(none)

    return F.flatten(F.transform(F.transform(block, folded), told))


def distinct_names(names: Column, letters: Column | None = None) -> Column:
    """array<struct<base, marks>>: each name once, where it comes first, by its marked form if there is one."""

    def each(own: Column) -> Column:
        keys = F.array_distinct(F.transform(own, lambda n: F.lower(n["base"])))
        same = lambda key: F.filter(own, lambda n: F.lower(n["base"]) == key)
        best = lambda like: F.coalesce(F.try_element_at(F.filter(like, lambda n: F.size(n["marks"]) > 0), F.lit(1)), F.try_element_at(like, F.lit(1)))
        return F.transform(F.filter(keys, lambda k: k != ""), lambda key: let(same(key), best))

    return let(F.transform(names, lambda n: unmarked(n, letters)), each)


def assembled(names: Column, places: Column, emails: Column, orcids: Column) -> Column:
    """array<struct<name, email, orcid, affiliation>>: the i-th address and ORCID go to the i-th name; with no name, one author an address."""
    row = lambda name, email, orcid, place: F.struct(name.alias("name"), email.alias("email"), orcid.alias("orcid"), place.alias("affiliation"))
    at = lambda array, i: F.try_element_at(array, i + 1)

    def place(marks: Column) -> Column:
        hits = F.flatten(F.transform(marks, lambda m: F.slice(F.filter(places, lambda p: p["mark"] == m), 1, 1)))
        return F.coalesce(F.try_element_at(hits, F.lit(1))["body"], F.try_element_at(places, F.lit(1))["body"])

    named = F.transform(names, lambda n, i: row(n["base"], at(emails, i), at(orcids, i), place(n["marks"])))
    mailed = F.transform(emails, lambda e: row(F.substring_index(e, "@", 1), e, at(orcids, F.lit(0)), F.lit(None).cast("string")))
    return F.when(F.size(names) > 0, named).otherwise(mailed)


def abstract(text: Column) -> Column:
    found = F.trim(F.regexp_extract(text, r"(?is)abstract\s*[.:\-]?\s*\n?(.{20,2000}?)(?:\n\s*\n|introduction\s*\n|keywords?\s*[:：])", 1))
    return F.when(found != "", found)


def headers(docs: DataFrame, text: str = "text", pages: str | None = None, name: str = "header") -> DataFrame:
    """`docs` with a struct<title, doi, authors, abstract> of each manuscript's head. Null and empty texts have neither."""
    own = [F.col(f"`{c}`") for c in docs.columns]
    plain = docs.select(F.struct(*own).alias("_row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"), (F.col(f"`{pages}`") if pages else F.array().cast("array<string>")).alias("_pages"))
    lined = plain.withColumn("_raw", header_lines(F.col("_pages"), F.col("_text")))
    described = lined.withColumn("_kinds", settle_kinds(describe(F.col("_raw"))))
    kept = described.withColumn("_kept", _from(F.col("_kinds"), preamble_size(F.col("_kinds"))))
    titled = kept.withColumn("_title", title_of(F.col("_kept")))
    blocked = titled.withColumn("_block", author_block(F.transform("_kept", lambda x: x["x"]), F.col("_title")))
    placed = blocked.withColumns({"_places": affiliations(F.col("_block")), "_named": author_names(F.col("_block")), "_head": F.array_join("_raw", "\n")})
    # Letters are marks where the block's affiliations begin with letters.
    by_letter = F.exists("_places", lambda p: p["mark"].rlike("^[a-z]$"))
    lettered = placed.withColumn("_letters", F.when(by_letter, F.array(*(F.lit(x) for x in "abcdefgh"))).otherwise(F.array().cast("array<string>")))
    unique = lettered.withColumn("_names", distinct_names(F.col("_named"), F.col("_letters")))
    people = assembled(F.col("_names"), F.col("_places"), T.extract_emails(F.col("_head")), T.extract_orcids(F.col("_head")))
    found = F.struct(F.try_element_at("_title", F.lit(1))["title"].alias("title"), T.extract_doi(F.col("_head")).alias("doi"), people.alias("authors"), abstract(F.col("_text")).alias("abstract"))
    return unique.select("_row.*", found.alias(name))
