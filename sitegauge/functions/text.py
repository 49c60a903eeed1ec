"""Text, date and identifier scalars."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .numbers import half_up, rate



def text_or_empty(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def trim_blank(value: Column) -> Column:
    return F.regexp_replace(value, f"^{P.BLANK}+|{P.BLANK}+$", "")


def collapse(value: Column) -> Column:
    """Blank runs to one blank, ends trimmed. Runs that are one blank already are left alone."""
    return F.trim(F.regexp_replace(text_or_empty(value), f"[{P.OTHER_BLANKS}]{P.BLANK}*+| {P.BLANK}++", " "))


def word_count(value: Column) -> Column:
    """Number of runs of non-blank characters."""
    return F.coalesce(F.regexp_count(value, F.lit(P.NON_BLANK_RUN)), F.lit(0))


def utf16_length(value: Column) -> Column:
    """Length in UTF-16 units: characters beyond the basic plane count twice."""
    return (F.octet_length(F.encode(text_or_empty(value), "UTF-16BE")) / 2).cast("int")


def normalized(value: Column) -> Column:
    """Lower case, anything but letters and digits becomes one blank."""
    text = F.regexp_replace(F.lower(text_or_empty(value)), "&nbsp;", " ")
    return F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "))


def contains_text(haystack: Column, needle: Column) -> Column:
    """N2, strict form: an empty needle is never contained."""
    key = normalized(needle)
    return (key != "") & F.contains(normalized(haystack), key)


def contains_text_or_blank(haystack: Column, needle: Column) -> Column:
    """N2, lenient form: an empty needle is contained in everything."""
    return F.contains(normalized(haystack), normalized(needle))


def digits(value: Column) -> Column:
    return F.regexp_replace(text_or_empty(value), r"[^0-9]+", "")


def phone_candidates(text: Column) -> Column:
    """Distinct phone-like runs with at least eight digits."""
    runs = P.find_all(text, r"\+?\d[\d\s().-]{7,}\d", flags="")
    trimmed = F.transform(runs, trim_blank)
    return F.array_distinct(F.filter(trimmed, lambda p: F.length(digits(p)) >= 8))


def phone_digits(candidates: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(candidates, digits), lambda d: d != ""))


def email_candidates(text: Column) -> Column:
    """N4."""
    return F.array_distinct(P.find_all(text, r"[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"))


def has_phone(text: Column) -> Column:
    return P.test(text, r"\+?\d[\d\s().-]{7,}\d", "")


def has_email(text: Column) -> Column:
    return P.test(text, r"[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}")


def has_postal_address(text: Column) -> Column:
    """N5, contact-page form: address word plus a run of two digits."""
    words = (
        r"\b(street|st\.|road|rd\.|avenue|ave\.|lane|ln\.|suite|floor|building|city|state|zip|postal|india|usa|uk)\b"
    )
    return P.test(text, words) & P.test(text, r"\d{2,}", "")


def visible_phone(text: Column) -> Column:
    return P.test(text, r"\+?\d[\d\s().-]{7,}", "")


def visible_address(text: Column) -> Column:
    """N5, local-signal form."""
    return P.test(
        text,
        r"\b(address|visit us|find us|located at|clinic|office|suite|floor|street|st\.|road|rd\.|avenue|ave\.|lane|"
        r"sector|block|near|opp\.|opposite|bangalore|bengaluru|delhi|mumbai|pune|hyderabad|chennai|kolkata|ncr)\b",
    )


def visible_nap(text: Column) -> Column:
    return visible_phone(text) & visible_address(text)


def visible_area_served(text: Column) -> Column:
    return P.test(
        text,
        r"\b(serving|serves|areas served|service area|locations served|available in|serving clients in|located in)\b"
        r".{0,100}\b[A-Z][A-Za-z]+",
    )


def copyright_years(text: Column, as_of: Column) -> Column:
    """Plausible years next to a copyright mark."""
    years = P.find_all(text, "(?:copyright|©|\\(c\\))\\s*(?:\\d{4}\\s*[-–]\\s*)?(\\d{4})", 1)
    numbers = F.transform(years, lambda y: y.cast("int"))
    return F.array_distinct(F.filter(numbers, lambda y: (y >= 1990) & (y <= F.year(as_of) + 1)))


def registration_numbers(text: Column) -> Column:
    return F.array_distinct(
        P.find_all(
            text,
            r"\b(?:GSTIN|GST|VAT|EIN|TIN|CIN|LLPIN|Company Registration(?: Number)?|Registration(?: Number)?|"
            r"Reg\.?\s*No\.?)[:#\s-]*[A-Z0-9-]{6,25}\b",
        )
    )


def policy_date(text: Column) -> Column:
    """Date after an "updated" wording, in the three written forms."""
    raw = P.find(
        text,
        r"\b(?:last updated|last modified|effective date|updated on|effective)\s*:?\s*"
        r"([A-Z][a-z]+\.?\s+\d{1,2},?\s+\d{4}|\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4})",
    )
    plain = collapse(F.regexp_replace(raw, "[.,]", " "))
    long_name = F.initcap(plain)
    parsed = F.coalesce(
        F.try_to_timestamp(plain, F.lit("yyyy-MM-dd")),
        F.try_to_timestamp(plain, F.lit("M/d/yyyy")),
        F.try_to_timestamp(long_name, F.lit("MMMM d yyyy")),
        F.try_to_timestamp(long_name, F.lit("MMM d yyyy")),
    )
    return parsed.cast("date")


def add_months_rolling(date: Column, months: int) -> Column:
    """Month arithmetic where a day past the month's end rolls into the next month."""
    first = F.add_months(F.trunc(date, "month"), months)
    return F.date_add(first, F.dayofmonth(date) - 1)


def let(value: Column, use) -> Column:
    """Evaluate ``value`` once and hand it to ``use`` as a lambda variable."""
    return F.get(F.transform(F.array(value), use), 0)


def heading_case(value: Column) -> Column:
    """Title / sentence / upper / mixed / unknown."""

    def classify(words: Column) -> Column:
        n = F.size(words)
        title_words = F.size(F.filter(words, lambda w: w.rlike("^[A-Z][a-z0-9]+")))
        lower_all = F.size(F.filter(words, lambda w: w.rlike("^[a-z0-9]")))
        lower_rest = lower_all - F.get(words, 0).rlike("^[a-z0-9]").cast("int")
        sentence = trim_blank(value).rlike("^[A-Z]") & (lower_rest >= F.greatest(F.lit(1), n - 2))
        return (
            F.when(n == 0, "unknown")
            .when(title_words >= n * 0.65, "title")
            .when(sentence, "sentence")
            .when((value == F.upper(value)) & value.rlike("[A-Z]"), "upper")
            .otherwise("mixed")
        )

    return let(F.filter(F.split(value, f"{P.BLANK}+"), lambda w: w.rlike("[A-Za-z]")), classify)


def dominant_case(cases: Column) -> Column:
    """Most frequent case; the one seen first wins a tie. ``unknown`` for no headings."""
    ranked = F.transform(
        F.array_distinct(cases),
        lambda c: F.struct(
            F.size(F.filter(cases, lambda x: x == c)).alias("n"),
            (-F.array_position(cases, c)).alias("first"),
            c.alias("kind"),
        ),
    )
    return F.coalesce(F.array_max(ranked)["kind"], F.lit("unknown"))


def is_quality_phrase(phrase: Column) -> Column:
    """Short bold phrase that names something."""
    named = P.test(phrase, "[A-Z][a-z]+", "") | P.test(phrase, r"\b[A-Z]{2,}\b", "")
    topical = P.test(phrase, r"\b(?:service|product|platform|brand|company|software|audit|seo|ai)\b")
    return (word_count(phrase) <= 6) & (named | topical)


def syllables(word: Column) -> Column:
    clean = F.regexp_replace(F.lower(word), "[^a-z]", "")
    groups = F.regexp_count(clean, F.lit("[aeiouy]+"))
    groups = F.when(groups == 0, 1).otherwise(groups)
    return F.greatest(F.lit(1), groups - F.when(clean.endswith("e"), 1).otherwise(0))


def syllable_total(text: Column, n_words: Column) -> Column:
    """Sum of :func:`syllables` over the words of a text, from counts over the whole text.

    A word has as many syllables as vowel groups, less one for a last e, but one at least: so words without a vowel,
    and words whose only group ends in a last e, count one more than groups less last e's.
    """
    letters = F.regexp_replace(F.lower(text_or_empty(text)), f"[^a-z{P.BLANKS}]+", "")
    count = lambda pattern: F.regexp_count(letters, F.lit(pattern))
    consonants = "[b-df-hj-np-tv-xz]*+"
    silent = count("e(?![a-z])")
    voiced = count(f"{consonants}[aeiouy][a-z]*+")
    only_silent = count(f"(?<![a-z]){consonants}[aeiouy]++(?<=e)(?![a-z])")
    return count("[aeiouy]++") - silent + (n_words - voiced) + only_silent


def flesch_reading_ease(text: Column) -> Column:
    """N10."""
    n = word_count(text)
    sentences = F.greatest(P.count(text, "[.!?]+", ""), F.lit(1))
    syl = syllable_total(text, n)
    return 206.835 - 1.015 * (n / sentences) - 84.6 * (syl / F.greatest(n, F.lit(1)))


def data_point_count(text: Column) -> Column:
    return P.count(text, r"\b\d+(?:\.\d+)?%|\b\d{4}\b|\b\d+(?:,\d{3})+\b", "")


def fact_count(text: Column) -> Column:
    return P.count(text, r"\b\d+(?:\.\d+)?%|\b\d{4}\b|\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b", "")


def listed_word_count(text: Column, words: tuple[str, ...]) -> Column:
    """Occurrences of whole words, any case; most texts hold none of them and are not searched."""
    lower = F.lower(text_or_empty(text))
    some = reduce(operator.or_, [F.contains(lower, F.lit(w)) for w in words])
    return F.when(some, P.count(text, rf"\b({'|'.join(words)})\b")).otherwise(0)


# Words that are counted.
EVIDENCE_WORDS = ("source", "reference", "according to", "study", "report", "research")
REVIEW_WORDS = ("review", "reviews", "rating", "ratings", "testimonial", "testimonials")
FRESH_WORDS = ("2024", "2025", "2026", "recent", "latest", "verified")


def evidence_word_count(text: Column) -> Column:
    return listed_word_count(text, EVIDENCE_WORDS)


def review_word_count(text: Column) -> Column:
    return listed_word_count(text, REVIEW_WORDS)


def fresh_review_count(text: Column) -> Column:
    return listed_word_count(text, FRESH_WORDS)


# Names and patterns counted by the text signals below.
REVIEW_SOURCES = ("google", "trustpilot", "g2", "capterra", "facebook", "yelp")
HEADING_PROGRESSION = ("what", "why", "how", "benefit", "comparison|compare|vs", "faq|question", "next|action")
FOLLOW_UPS = ("pricing", "comparison|compare|vs", "alternatives?", "setup", "implementation", "faq|questions")


def review_source_count(text: Column) -> Column:
    lower = F.lower(text_or_empty(text))
    return sum((F.contains(lower, F.lit(name)).cast("int") for name in REVIEW_SOURCES), F.lit(0))


def pattern_coverage(text: Column, patterns_: tuple[str, ...]) -> Column:
    """How many of the patterns occur (H2 progression, follow-up sections). Patterns are plain words joined by ``|``."""
    lower = F.lower(text_or_empty(text))
    plain = lambda word: word[:-2] if word.endswith("?") else word  # an optional last letter does not matter for a find
    some = lambda pattern: reduce(operator.or_, [F.contains(lower, F.lit(plain(w))) for w in pattern.split("|")])
    return sum((some(p).cast("int") for p in patterns_), F.lit(0))


def entity_set(text: Column) -> Column:
    """Capitalised phrases and numbers, lower-cased and distinct."""
    hits = P.find_all(text, r"\b(?:[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*|\d+(?:\.\d+)?%?|\d{4})\b", flags="")
    return F.array_distinct(F.transform(hits, F.lower))


def entity_overlap_percent(left: Column, right: Column) -> Column:
    """Share of ``left`` entities that ``right`` has too, in whole percent."""
    ours = entity_set(left)
    shared = F.size(F.array_intersect(ours, entity_set(right)))
    return F.when(F.size(ours) > 0, half_up(rate(shared, F.size(ours)) * 100)).otherwise(F.lit(0))


QUESTION_WORDS = r"\?|\b(what|how|why|when|where|who|can|does|is|are)\b"


def question_signals(text: Column, headings: Column) -> Column:
    """Question marks in the text plus question-like headings."""
    return P.count(text, r"\?", "") + F.size(F.filter(headings, lambda h: P.test(h, QUESTION_WORDS)))


def llms_sections(text: Column) -> Column:
    """Markdown headings plus links of an llms.txt."""
    return P.count(text, r"^#{1,3}\s+\S.+$", "m") + P.count(text, r"https?://\S+", "")


def rolling_hash(text: Column) -> Column:
    """32-bit polynomial hash (multiplier 31) over the characters."""
    chars = F.filter(F.split(text_or_empty(text), ""), lambda c: c != "")
    return F.aggregate(
        chars,
        F.lit(2166136261).cast("long"),
        lambda acc, c: (acc * 31 + F.ascii(c)).bitwiseAND(F.lit(4294967295).cast("long")),
    )


def csv_cell(value: Column) -> Column:
    """N18."""
    return F.concat(F.lit('"'), F.replace(text_or_empty(value.cast("string")), F.lit('"'), F.lit('""')), F.lit('"'))
