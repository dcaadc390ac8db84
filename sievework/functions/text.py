"""Scalar functions over text as Column builders: normal forms, identifiers, token sets, similarities.

All of them are built-in expressions, so they stay inside whole-stage code generation and filters on
them are evaluated with the scan. Null gives null unless a function says otherwise.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Domains of public mail providers.
PUBLIC_DOMAINS = (
    "gmail.com", "googlemail.com", "outlook.com", "hotmail.com", "live.com", "msn.com", "icloud.com", "me.com", "yahoo.com",
    "aol.com", "proton.me", "protonmail.com", "qq.com", "163.com", "126.com", "sina.com",
)
# Words that say nothing about an institution.
INSTITUTION_STOP_WORDS = (
    "the", "of", "and", "for", "department", "dept", "school", "college", "faculty", "institute", "center", "centre",
    "laboratory", "lab", "university", "hospital", "medical", "research", "science", "sciences",
)
# Words that say nothing about a title.
TITLE_STOP_WORDS = (
    "a", "an", "the", "of", "in", "on", "for", "and", "or", "to", "at", "by", "with", "from", "as", "is", "are", "be", "this",
    "that", "these", "those", "via", "using", "based",
)
# Patterns of identifiers.
DOI_PATTERN = r"(?i)\b10\.\d{4,9}/[^\s)\]>\"<]+"
PMID_PATTERN = r"(?i)(?:pmid[:\s]*|pubmed[:\s]+)(\d{5,9})"
YEAR_PATTERN = r"(?:19|20)\d{2}"
EMAIL_PATTERN = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,24}"
ORCID_PATTERN = r"\b(?:https?://orcid\.org/)?(\d{4}-\d{4}-\d{4}-\d{3}[\dX])\b"
HAN = r"[\x{4e00}-\x{9fff}]"


def _folds() -> tuple[str, str]:
    """Letters with marks and their plain letters, from the Unicode decompositions."""
    plain = {}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        bare = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(bare) == 1 and bare != chr(code):
            plain[chr(code)] = bare
    return "".join(plain), "".join(plain.values())


MARKED, PLAIN = _folds()


def strip_marks(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, MARKED, PLAIN), r"\p{M}", "")


def normalize_text(text: Column) -> Column:
    """Without marks, lower case, every run that is no letter or number one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(strip_marks(text)), r"[^\p{L}\p{N}]+", " "))


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda t: t != "")


def normalize_doi(value: Column) -> Column:
    """Bare lower-case identifier; empty where missing or marked unavailable."""
    bare = F.trim(F.coalesce(value, F.lit("")))
    cut = F.regexp_replace(F.regexp_replace(bare, r"(?i)^https?://(dx\.)?doi\.org/", ""), r"(?i)^doi:\s*", "")
    done = F.lower(F.regexp_replace(cut, r"[.,;)\]>\"'\s]+$", ""))
    return F.when(F.lower(bare) == "unavailable", "").otherwise(done)


def normalize_pmid(value: Column) -> Column:
    """Digits only; empty where missing or 0."""
    bare = F.trim(F.coalesce(value, F.lit("")))
    return F.when(bare.isin("", "0"), "").otherwise(F.regexp_replace(bare, r"\D+", ""))


def email_domain(email: Column) -> Column:
    """What follows the last @ (or all), without www., only letters, digits, dots and dashes; empty without a dot."""
    tail = F.regexp_replace(F.substring_index(F.lower(F.trim(F.coalesce(email, F.lit("")))), "@", -1), r"^www\.", "")
    kept = F.regexp_replace(tail, r"[^a-z0-9.\-]", "")
    return F.when(kept.contains("."), kept).otherwise("")


def is_public_domain(domain: Column) -> Column:
    return domain.isin(*PUBLIC_DOMAINS)


def domain_tokens(domain: Column) -> Column:
    """Distinct tokens of more than two letters, without the last label."""
    labels = F.split(domain, r"\.")
    body = F.array_join(F.slice(labels, 1, F.greatest(F.size(labels) - 1, F.lit(0))), " ")
    return F.array_distinct(F.filter(tokens(normalize_text(body)), lambda t: F.length(t) > 2))


def name_parts(name: Column) -> Column:
    """struct<normalized, tokens, surname, initials, signature, variants> of a personal name."""
    return F.transform(F.array(normalize_text(name)), _parts)[0]


def _parts(normalized: Column) -> Column:
    words = tokens(normalized)
    several = F.size(words) > 1
    han = (F.size(words) > 0) & F.forall(words, lambda w: w.rlike(f"^{HAN}+$"))
    surname = F.coalesce(F.when(han, F.try_element_at(words, F.lit(1))).otherwise(F.try_element_at(words, F.lit(-1))), F.lit(""))
    initials = F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")
    reversed_ = F.when(several, F.array_join(F.reverse(words), " ")).otherwise(normalized)
    short = F.when(several, F.concat(F.substring(words[0], 1, 1), F.lit(" "), surname)).otherwise(normalized)
    signature = F.array_join(F.filter(F.array(surname, initials), lambda x: x != ""), ":")
    variants = F.array_distinct(F.filter(F.array(normalized, reversed_, short), lambda x: x != ""))
    return F.struct(normalized.alias("normalized"), words.alias("tokens"), surname.alias("surname"), initials.alias("initials"), signature.alias("signature"), variants.alias("variants"))


def _given(name: Column) -> Column:
    words = name["tokens"]
    own = F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0)))
    return F.array_join(F.filter(own, lambda t: F.length(t) > 1), "")


def given_names_conflict(left: Column, right: Column) -> Column:
    """Same surname, given names of more than a letter on both sides, and they differ."""
    a, b = _given(left), _given(right)
    return (left["surname"] != "") & (left["surname"] == right["surname"]) & (a != "") & (b != "") & (a != b)


def institution_tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(tokens(normalize_text(text)), lambda t: (F.length(t) > 2) & ~t.isin(*INSTITUTION_STOP_WORDS)))


def token_overlap(left: Column, right: Column) -> Column:
    """Shared tokens over the larger set, or over the smaller one from two shared tokens on; 0 if a set is empty."""
    shared = F.size(F.array_intersect(left, right)).cast("double")
    small, large = F.least(F.size(left), F.size(right)), F.greatest(F.size(left), F.size(right))
    return F.when(small < 1, 0.0).when(shared < 2, shared / large).otherwise(shared / small)


def jaccard(left: Column, right: Column, both_empty: float = 0.0) -> Column:
    shared = F.size(F.array_intersect(left, right)).cast("double")
    union = F.size(left) + F.size(right) - shared
    return F.when(union > 0, shared / union).otherwise(both_empty)


def normalize_title(title: Column) -> Column:
    head = F.regexp_replace(title, "^[\\s\"'“”‘’]+", "")
    return normalize_text(F.regexp_replace(head, "[\\s\"'“”‘’.?,;:!]+$", ""))


def title_tokens(title: Column) -> Column:
    """Distinct telling words; words with Han characters as overlapping pairs of characters."""

    def split(word: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.length(word) - 1), lambda i: F.substr(word, i, F.lit(2)))
        wide = F.when(F.length(word) == 1, F.array(word)).otherwise(pairs)
        telling = (F.length(word) > 2) & ~word.isin(*TITLE_STOP_WORDS)
        return F.when(word.rlike(HAN), wide).when(telling, F.array(word)).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.flatten(F.transform(tokens(normalize_title(title)), split)))


def extract_doi(text: Column) -> Column:
    """First identifier in a text, lower case, without trailing marks and file endings; null if none."""
    found = F.regexp_extract(text, f"({DOI_PATTERN})", 1)
    bare = F.regexp_replace(F.regexp_replace(found, r"[.,;)\]>\"]+$", ""), r"(?i)\.(?:url|html?|pdf|md|txt|aspx?|jsp|php)$", "")
    bare = F.regexp_replace(bare, r"[.,;)\]>]+$", "")
    return F.when(bare != "", F.lower(bare))


def extract_pmid(text: Column) -> Column:
    found = F.regexp_extract(text, PMID_PATTERN, 1)
    return F.when(found != "", found)


def extract_year(text: Column) -> Column:
    found = F.regexp_extract(text, f"({YEAR_PATTERN})", 1)
    return F.when(found != "", found.cast("int"))


def extract_emails(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(EMAIL_PATTERN), F.lit(0)))


def extract_orcids(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(ORCID_PATTERN), F.lit(1)))


def semicolon_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ";"), lambda x: F.trim(x)), lambda x: x != "")


# Shapes of volume, issue and page strings that are no titles.
NOISE_SHAPES = (r"^[A-Z][a-z]{2}\.?\s*\d+\s*[;:]", r"^\d+\s*\(\d+\)\s*[:;]", r"^(19|20)\d{2}\s*[;:]\s*\d+", r"^\d+\s*:\s*\d+[\s\-–]?\d*\.?$", r"^pp?\.?\s*\d+")


def distinct_values(values: Column) -> Column:
    """A list of values as asked for: trimmed, without blanks, each once, in order; a missing list is empty."""
    bare = F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.regexp_replace(v, r"^\s+|\s+$", ""))
    return F.array_distinct(F.filter(bare, lambda v: v != ""))


def is_title_noise(title: Column) -> Column:
    bare = F.trim(title)
    shapes = reduce(lambda a, b: a | b, (bare.rlike(p) for p in NOISE_SHAPES))
    return (F.length(bare) < 8) | ~bare.rlike(r"[A-Za-z\x{4e00}-\x{9fff}]") | shapes


def clean_page_text(text: Column) -> Column:
    """Odd spaces to spaces, line-end hyphens joined, spaces at line ends, runs of spaces and of blank lines folded."""
    steps = ((r"[\x{00a0}\x{202f}\x{2007}\x{2009}\x{200a}]", " "), (r"\r", ""), (r"-\n(?=[a-z\x{4e00}-\x{9fff}])", ""), (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n"), (r"[ \t]{2,}", " "))
    out = reduce(lambda t, step: F.regexp_replace(t, *step), steps, text)
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def fix_split_doi(text: Column) -> Column:
    """Rejoin identifiers that white space broke, up to 120 characters."""
    return F.regexp_replace(text, r"(?i)(10\.\d{4,9}/(?=[\w./-]{0,120}\s)[\w./-]*?)\s+([a-z0-9][\w./-]{0,110})", "$1$2")


def unwrap_blob(block: Column) -> Column:
    """A newline before each numbered marker, in long blocks that have next to none."""
    marker = r" (?=(?:\d{1,3}\.\s+|\[\d+\]\s+)[A-Z\x{4e00}-\x{9fff}])"
    newlines = F.length(block) - F.length(F.replace(block, F.lit("\n"), F.lit("")))
    blob = (F.length(block) >= 3000) & (newlines <= 0.001 * F.length(block)) & (F.regexp_count(block, F.lit(marker)) >= 5)
    return F.when(blob, F.regexp_replace(block, marker, "\n")).otherwise(block)


#: Characters of a name that give its 200 in most cases.
NAME_FRONT = 1000


def safe_file_name(name: Column) -> Column:
    """The last path part, other characters than letters, digits, Han, dots, dashes as one underscore, at most 200.

    What a front of the part gives is the front of what all of it gives, so the whole part is only gone through where its front gives fewer than 200.
    """
    steps = ((r"^\.+", "_"), (r"[^A-Za-z0-9._\x{4e00}-\x{9fff}-]+", "_"), (r"\.{2,}", "."), (r"_{2,}", "_"))
    cleaned = lambda part: F.substring(reduce(lambda t, step: F.regexp_replace(t, *step), steps, part), 1, 200)
    leaf = F.substring_index(F.rtrim(F.replace(name, F.lit("\\"), F.lit("/")), F.lit("/")), "/", -1)

    def told(part: Column) -> Column:
        whole = lambda x: F.when((F.length(x) < 200) & (F.length(part) > NAME_FRONT), cleaned(part)).otherwise(x)
        front = F.transform(F.array(cleaned(F.left(part, F.lit(NAME_FRONT)))), whole)[0]
        return F.transform(F.array(front), lambda x: F.when(x == "", "upload.bin").otherwise(x))[0]

    return F.transform(F.array(leaf), told)[0]


def ip_pseudonym(ip: Column, salt: str) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(salt + ":"), ip), 256), 1, 16)


def encrypt_field(text: Column, key: bytes) -> Column:
    """AES-256-GCM, framed as enc:v1:iv:tag:ciphertext (base64)."""
    raw = F.aes_encrypt(text.cast("binary"), F.lit(key), F.lit("GCM"))
    size = F.octet_length(raw)
    parts = (F.substring(raw, 1, 12), F.substr(raw, size - 15, F.lit(16)), F.substr(raw, F.lit(13), size - 28))
    return F.concat_ws(":", F.lit("enc:v1"), *(F.base64(p) for p in parts))


def decrypt_field(text: Column, key: bytes) -> Column:
    """The inverse of encrypt_field; what is not framed like that stays as it is."""
    parts = F.split(text, ":")
    raw = F.concat(F.unbase64(parts[2]), F.unbase64(parts[4]), F.unbase64(parts[3]))
    return F.when(text.startswith("enc:v1:"), F.try_aes_decrypt(raw, F.lit(key), F.lit("GCM")).cast("string")).otherwise(text)


def levenshtein_ratio(left: Column, right: Column) -> Column:
    longest = F.greatest(F.length(left), F.length(right))
    return F.when(longest > 0, 1 - F.levenshtein(left, right) / longest).otherwise(1.0)


def found_without_spaces(part: Column, text: Column) -> Column:
    """Is the part in the text, white space and case aside?"""
    squeeze = lambda x: F.lower(F.regexp_replace(x, r"\s+", ""))
    return (F.coalesce(part, F.lit("")) != "") & squeeze(text).contains(squeeze(part))


def file_type(name: Column) -> Column:
    end = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    return F.when(end.isin("pdf", "docx"), end).when(end.isin("tex", "zip"), "latex").otherwise("unknown")
