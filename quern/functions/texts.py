"""Row-level text expressions: splitting, packing, scripts, facets and checks of a text against what it may say."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?"
EMPTY = "array<string>"


def last_digits(value: Column) -> Column:
    """The last run of digits, or ""."""
    return F.regexp_extract(value, r"([0-9]+)[^0-9]*$", 1)


def flag_names(flags: Column) -> Column:
    """Flags without what follows the first colon."""
    return F.transform(flags, lambda x: F.split_part(x, F.lit(":"), F.lit(1)))


def hard_split(text: Column, most: int) -> Column:
    """Pieces of at most ``most`` characters, cut at blanks; a longer single word stays whole."""
    def step(acc: Column, w: Column) -> Column:
        fits = F.length(acc["cur"]) + 1 + F.length(w) <= most
        return (
            F.when(acc["cur"] == "", F.struct(acc["out"].alias("out"), w.alias("cur")))
            .when(fits, F.struct(acc["out"].alias("out"), F.concat(acc["cur"], F.lit(" "), w).alias("cur")))
            .otherwise(F.struct(F.concat(acc["out"], F.array(acc["cur"])).alias("out"), w.alias("cur")))
        )
    start = F.struct(F.array().cast(EMPTY).alias("out"), F.lit("").alias("cur"))
    folded = F.aggregate(F.split(text, " "), start, step, lambda acc: F.when(acc["cur"] == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["cur"]))))
    return F.when(F.length(text) <= most, F.array(text)).otherwise(folded)


def pack(pieces: Column, most: int, least: int) -> Column:
    """Greedy windows of consecutive pieces, joined by blanks: a window is full where the next piece and a blank would pass ``most``.

    Each piece counts its characters and one.  A last window below ``least`` joins the one before if both have at most most + least.
    """
    size = lambda x: F.length(x) + 1
    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        return F.when((F.size(acc) > 0) & (size(last) + size(s) <= most), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(last, F.lit(" "), s)))).otherwise(F.concat(acc, F.array(s)))
    def tail(acc: Column) -> Column:
        last, before = F.element_at(acc, -1), F.get(acc, F.size(acc) - 2)
        short = (F.size(acc) > 1) & (size(last) < least) & (size(last) + size(before) <= most + least)
        return F.when(short, F.concat(F.slice(acc, 1, F.size(acc) - 2), F.array(F.concat(before, F.lit(" "), last)))).otherwise(acc)
    return F.aggregate(pieces, F.array().cast(EMPTY), step, tail)


def contained(quote: Column, page: Column) -> Column:
    """exact, loose (letters and digits only, lower case) or failed."""
    bare = lambda x: F.lower(F.regexp_replace(x, r"[^0-9A-Za-z]", ""))
    return F.when(F.contains(page, quote), "exact").when((bare(quote) != "") & F.contains(bare(page), bare(quote)), "loose").otherwise("failed")


def script_problems(text: Column, letters: str, least: float) -> Column:
    """Reasons why a text is not in the wanted script (a character class): other_script, no_letters, low_share."""
    wanted = F.regexp_count(text, F.lit(f"[{letters}]"))
    all_ = F.regexp_count(text, F.lit(r"\p{L}"))
    return F.array_compact(F.array(
        F.when(F.regexp_count(text, F.lit(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]")) > 0, "other_script"),
        F.when(all_ == 0, "no_letters"),
        F.when((all_ > 0) & (wanted < all_ * least), "low_share"),
    ))


def facets(text: Column, patterns: dict[str, str]) -> Column:
    """Names of the patterns found in a text, in the order given."""
    return F.array_compact(F.array(*[F.when(F.coalesce(F.rlike(text, F.lit(p)), F.lit(False)), n) for n, p in patterns.items()]))


def tokens(text: Column, pattern: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def lock_reasons(text: Column, allowed: Column, kinds: dict[str, str]) -> Column:
    """For each kind of token: ``extra_kind`` if the text has one that ``allowed`` (a text) lacks, ``missing_kind`` for the reverse."""
    out = []
    for name, pattern in kinds.items():
        has, may = tokens(text, pattern), tokens(allowed, pattern)
        out += [F.when(F.size(F.array_except(has, may)) > 0, f"extra_{name}"), F.when(F.size(F.array_except(may, has)) > 0, f"missing_{name}")]
    return F.array_compact(F.array(*out))


def anchored_verdict(text: Column, anchors: list[tuple[str, str]]) -> Column:
    """The value of the first pattern, in the order given, that matches the text without its tags; else null."""
    plain = F.regexp_replace(text, r"<[^>]*>", " ")
    out = F.lit(None).cast("string")
    for pattern, value in reversed(anchors):
        out = F.when(F.rlike(plain, F.lit(pattern)), value).otherwise(out)
    return out


def page_ranges(pages: Column, most_gap: int = 2) -> Column:
    """Sorted distinct pages as ranges "a-b"; a page at most ``most_gap`` after the last one joins its range."""
    def step(acc: Column, p: Column) -> Column:
        last = F.element_at(acc, -1)
        joins = (F.size(acc) > 0) & (p <= last["hi"] + most_gap)
        return F.when(joins, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["lo"].alias("lo"), p.alias("hi"))))).otherwise(F.concat(acc, F.array(F.struct(p.alias("lo"), p.alias("hi")))))
    ranges = F.aggregate(F.array_sort(F.array_distinct(pages)), F.array().cast("array<struct<lo:bigint,hi:bigint>>"), step)
    return F.transform(ranges, lambda r: F.concat_ws("-", r["lo"].cast("string"), r["hi"].cast("string")))


def clean_reason(text: Column, most: int = 200) -> Column:
    """The first line with content, without tags, cut to ``most`` characters; "" if there is none."""
    # Not F.trim itself: it takes a second column, for which transform would give the line's number.
    lines = F.filter(F.transform(F.split(F.regexp_replace(text, r"<[^>]*>", ""), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(F.substr(F.get(lines, F.lit(0)), F.lit(1), F.lit(most)), F.lit(""))


def mixed_language(text: Column, letters: str, least: float, words: int) -> Column:
    """Reasons why a text is not in the language of a script (a character class): mixed_cjk, mixed_sentence (that many Latin words in a row),
    low_share (fewer than ``least`` of its own, Latin and Han letters are its own, or it has none)."""
    word = r"[A-Za-z][A-Za-z'’\-]*"
    own, latin, han = (F.regexp_count(text, F.lit(p)) for p in (f"[{letters}]", "[A-Za-z]", r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]"))
    all_ = own + latin + han
    return F.array_compact(F.array(
        F.when(F.regexp_count(text, F.lit(r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{3040}-\x{30FF}]")) > 0, "mixed_cjk"),
        F.when(text.rlike(rf"\b{word}(?:[\s,;:]+{word}){{{words - 1}}}"), "mixed_sentence"),
        F.when((all_ == 0) | (own < all_ * least), "low_share"),
    ))


# Patterns of paid standards' names, of quotations of their publisher, of numbers with units, and by document of what refers to one.
PAID_NAME = (
    r"\b(?:ISO\s*\d{3,5}|AWS\b|D1\.[1-9]\b|Bridge Welding Code|ANSI/AWS|ASME|ASTM\s*[A-Z]\d|API\s*\d{3,4}|KS\s*[A-Z]\s*\d{3,4}|JIS\s*[A-Z]\s*\d{3,4}|EN\s*\d{3,5}|BS\s*\d{3,5}|AASHTO|CSA\s*W\d+|AS/NZS|DIN\s*\d{3,5})"
)
PAID_QUOTE = r"(?i)\(\s*(?:AASHTO\s*/\s*)?AWS\s*,?\s*\d{4}[a-z]?\.?\s*\)|\bAWS\s+A\d|\bas defined (?:by|in) AWS\b"
NUMBER_UNIT = (
    r"(?i)(?:\d+(?:\.\d+)?(?:\s*/\s*\d+)?|\d*[¼½¾⅛⅜⅝⅞⅓⅔])\s*-?\s*(?:mm|cm|in\.|inch|inches|ft|feet|foot|°\s*[FC]?|deg(?:ree)?s?|ksi|psi|MPa|%|percent)(?![A-Za-z])|\b\d+(?:\.\d+)?t\b"
)
IMPLIED = {"MANUAL": r"(?i)\bthe Code\b|\bclauses?\s+C?-?\d+(?:\.\d+)+|\b(?:table|figure)\s+\d+\.\d+"}


def paid_reference(sentence: Column, doc: Column) -> Column:
    """Whether a sentence names a paid standard, or refers to one in the way of its document."""
    out = sentence.rlike(PAID_NAME)
    for name, pattern in IMPLIED.items():
        out |= F.coalesce(doc == name, F.lit(False)) & sentence.rlike(pattern)
    return out


def paid_reason(sentence: Column, doc: Column) -> Column:
    """third_party_quote, paid_numeric (a reference and a number with a unit), or null."""
    return F.when(sentence.rlike(PAID_QUOTE), "third_party_quote").when(paid_reference(sentence, doc) & sentence.rlike(NUMBER_UNIT), "paid_numeric")


def sentence_pages(text: Column, marks: Column) -> Column:
    """Array of struct(sentence, first, last): sentences with the pages of their first and last character.

    marks: array of struct(offset, page) in order; the first page stands for all before the second.
    """
    from quern.functions.scalars import sentences

    page = lambda at: F.coalesce(F.element_at(F.filter(marks, lambda m: m["offset"] <= at), -1)["page"], F.get(marks, F.lit(0))["page"])
    def step(acc: Column, s: Column) -> Column:
        found = F.call_function("locate", s, text, (acc["pos"] + 1).cast("int")) - 1
        at = F.when(found < 0, acc["pos"]).otherwise(found).cast("int")
        one = F.struct(s.alias("sentence"), page(at).cast("int").alias("first"), page(at + F.greatest(F.length(s) - 1, F.lit(0))).cast("int").alias("last"))
        return F.struct((at + F.length(s)).cast("int").alias("pos"), F.concat(acc["out"], F.array(one)).alias("out"))
    start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<sentence: string, first: int, last: int>>").alias("out"))
    return F.aggregate(sentences(text), start, step, lambda acc: acc["out"])


def clean_characters(text: Column, symbols: dict[str, str], mark: str = "□", soft: str = "￾") -> Column:
    """struct(text, mapped, unmapped, joined): known signs of the private area replaced, others marked, soft hyphens joined; composed."""
    from quern.functions.generated import normal_form

    known = "".join(symbols)
    mapped = F.regexp_count(text, F.lit(f"[{known}]"))
    private = F.regexp_count(text, F.lit(r"[\x{E000}-\x{F8FF}]"))
    out = F.regexp_replace(F.translate(text, known, "".join(symbols.values())), r"[\x{E000}-\x{F8FF}]", mark)
    joined = F.regexp_count(text, F.lit(soft))
    return F.struct(normal_form(F.replace(out, F.lit(soft), F.lit(""))).alias("text"), mapped.alias("mapped"), (private - mapped).alias("unmapped"), joined.alias("joined"))


def xml_body(xml: Column) -> Column:
    """The text of the first element ``body`` of any namespace, else of the whole document, pieces apart by one blank."""
    squeeze = lambda a: F.trim(F.regexp_replace(F.array_join(a, " "), r"\s+", " "))
    body = F.xpath(xml, F.lit("(//*[local-name()='body'])[1]//text()"))
    return F.when(F.xpath_boolean(xml, F.lit("boolean(//*[local-name()='body'])")), squeeze(body)).otherwise(squeeze(F.xpath(xml, F.lit("//text()"))))


def tier(text: Column, patterns: list[tuple[str, str]]) -> Column:
    """The name of the first pattern that a text has; null without any."""
    out = F.lit(None).cast("string")
    for name, p in reversed(patterns):
        out = F.when(F.coalesce(F.rlike(text, F.lit(p)), F.lit(False)), name).otherwise(out)
    return out


def allowed_numbers(target: list[Column], passages: list[Column], defects: Column) -> Column:
    """The distinct numbers, in order, of target and passage texts (those of 64 hexadecimal digits left out) and the number of locked defects."""
    number = r"(?<![A-Za-z0-9_.])(\d{1,3}(?:,\d{3})+|\d+)(?:\.(\d+))?"
    def of(t: Column) -> Column:
        whole = F.regexp_extract_all(t, F.lit(number), F.lit(0))
        values = F.transform(whole, lambda x: F.replace(x, F.lit(","), F.lit("")).cast("decimal(28,10)"))
        return F.when(t.rlike("^[0-9a-f]{64}$"), F.array().cast("array<decimal(28,10)>")).otherwise(values)
    n = F.array(F.size(defects).cast("decimal(28,10)"))
    return F.array_sort(F.array_distinct(F.concat(*[of(t) for t in [*target, *passages]], n)))
