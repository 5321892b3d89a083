"""Text normalisation and parsing as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
LEGAL_SUFFIXES = ("llc", "llp", "lp", "inc", "incorporated", "ltd", "limited", "corp", "corporation", "plc", "gmbh")
GENERIC_DOMAINS = ("gmail.com", "googlemail.com", "outlook.com", "hotmail.com", "live.com", "yahoo.com", "icloud.com", "aol.com", "proton.me", "protonmail.com")
UOM_ALIASES = {"each": "EA", "ea": "EA", "pc": "EA", "pcs": "EA", "piece": "EA", "pieces": "EA", "kilogram": "KG", "kg": "KG", "box": "BOX", "boxes": "BOX"}


def _text(s: Column) -> Column:
    return F.coalesce(s, F.lit(""))


def norm_key(s: Column) -> Column:
    """Lower case letters and digits only; null is empty."""
    return F.regexp_replace(F.lower(_text(s)), "[^a-z0-9]", "")


def norm_supplier(s: Column) -> Column:
    """A company's name without its legal suffixes (and one spelled-out l l c or l l p), letters and digits only."""
    tokens = F.trim(F.regexp_replace(F.lower(_text(s)), "[^a-z0-9]+", " "))
    tokens = F.regexp_replace(tokens, "(^| )l l [cp]$", "")
    tokens = F.regexp_replace(tokens, f"(( |^)({'|'.join(LEGAL_SUFFIXES)}))+$", "")
    return F.replace(tokens, F.lit(" "), F.lit(""))


def norm_email(s: Column) -> Column:
    return F.lower(F.trim(_text(s)))


def email_domain(s: Column) -> Column:
    """After the last @; empty without one."""
    e = norm_email(s)
    return F.when(F.contains(e, F.lit("@")), F.substring_index(e, "@", -1)).otherwise("")


def squeeze(s: Column) -> Column:
    """HTML entities decoded, white space runs as one space, trimmed."""
    out = _text(s)
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def norm_subject(s: Column) -> Column:
    """Without any leading re:, fw: and fwd:."""
    return F.trim(F.regexp_replace(squeeze(s), r"(?i)^((re|fw|fwd)\s*:\s*)+", ""))


def norm_message_id(s: Column) -> Column:
    """The first <...>, else the squeezed text, of at most 998 characters; empty is null."""
    bracketed = F.regexp_extract(_text(s), "<[^<>]+>", 0)
    return F.nullif(F.substring(F.when(bracketed != "", bracketed).otherwise(squeeze(s)), 1, 998), F.lit(""))


def norm_label(s: Column) -> Column:
    """Case folded, runs of other characters than letters and digits as one space."""
    return F.trim(F.regexp_replace(F.replace(F.lower(_text(s)), F.lit("ß"), F.lit("ss")), "[^a-z0-9]+", " "))


def norm_uom(s: Column) -> Column:
    """Known unit names to their code, others in upper case; null stays null."""
    key = F.lower(F.trim(s))
    known = F.create_map(*(F.lit(x) for pair in UOM_ALIASES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, key), F.upper(F.trim(s)))


def clean_sku(s: Column) -> Column:
    """Spaces around - / . removed; null for text with a colon or bar, or without any character."""
    joined = F.regexp_replace(F.trim(s), r"\s*([-/.])\s*", "$1")
    return F.when(s.rlike("[:|]") | (joined == ""), None).otherwise(joined)


def ocr_repair(s: Column) -> Column:
    """Spaces that recognition put around - and / between alphanumerics, and inside decimal numbers, removed."""
    out = F.regexp_replace(s, r"(?<=[A-Za-z0-9])\s*([-/])\s*(?=[A-Za-z0-9])", "$1")
    return F.regexp_replace(out, r"(?<=\d)\s*\.\s+(?=\d)|(?<=\d)\s+\.\s*(?=\d)", ".")


def decimal_suspect(s: Column) -> Column:
    """Two or three bare digits: a decimal mark may have been lost."""
    return F.coalesce(F.trim(s).rlike(r"^\d{2,3}$"), F.lit(False))


def rfq_token(s: Column) -> Column:
    """The first request number as RFQ-n (3 to 12 digits), else null."""
    short = F.regexp_extract(_text(s), r"(?i)\bRFQ\s*[-#:]?\s*(\d{3,12})\b", 1)
    long = F.regexp_extract(_text(s), r"(?i)\bRequest\s+for\s+Quote\s*#?\s*(\d{3,12})\b", 1)
    digits = F.when(short != "", short).otherwise(long)
    return F.when(digits != "", F.concat(F.lit("RFQ-"), digits))


def safe_filename(s: Column) -> Column:
    """The last part of a path, at most 200 characters."""
    return F.substring(F.substring_index(F.replace(_text(s), F.lit("\\"), F.lit("/")), "/", -1), 1, 200)


def column_name(i: Column) -> Column:
    """0 is A, 25 is Z, 26 is AA, 702 is AAA, as far as whole numbers go."""
    digits = F.sequence(F.lit(1), F.lit(7))
    # place p is filled once numbers of fewer places are used up: 26 + 26^2 + ... + 26^(p - 1) names
    fewer = lambda p: (F.pow(F.lit(26), p) - 26) / 25
    letter = lambda p: F.char(F.pmod(F.floor((i - fewer(p)) / F.pow(F.lit(26), p - 1)), F.lit(26)).cast("int") + 65)
    return F.reverse(F.array_join(F.transform(F.filter(digits, lambda p: i >= fewer(p)), letter), ""))


def content_hash(*parts: Column) -> Column:
    """SHA-256 of the parts, null as empty, joined by newlines."""
    return F.sha2(F.concat_ws("\n", *(_text(p.cast("string")) for p in parts)).cast("binary"), 256)


def html_to_text(h: Column) -> Column:
    """Visible text: scripts, styles and heads dropped, block tags as line breaks, lines trimmed, empty ones dropped."""
    out = F.regexp_replace(_text(h), r"(?is)<(script|style|head)\b[^>]*>.*?</\1\s*>", "")
    out = F.regexp_replace(out, r"(?is)<!--.*?-->", "")
    out = F.regexp_replace(out, r"(?i)</?(p|div|br|tr|li|ul|ol|table|h[1-6]|section|article|blockquote)\b[^>]*>", "\n")
    lines = F.transform(F.split(F.regexp_replace(out, r"<[^>]*>", ""), "\n"), squeeze)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def html_rows(h: Column) -> Column:
    """Rows of all tables as arrays of cell texts; rows without any text are dropped."""
    rows = F.regexp_extract_all(_text(h), F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr\s*>"), 1)
    cells = F.transform(
        rows,
        lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]\s*>"), 1), lambda c: squeeze(F.regexp_replace(c, r"<[^>]*>", " "))),
    )
    return F.filter(cells, lambda r: F.exists(r, lambda c: c != ""))


# Lines that start quoted history, lines that start a signature, and the words of each kind of message, the
# first kind that fits.
HISTORY = (r"^\s*On .{3,200}wrote:\s*$", r"^\s*-{2,}\s*Original Message\s*-{2,}\s*$", r"^\s*From:\s+.+@.+$", r"^\s*_{5,}\s*$", r"^\s*>")
SIGNATURE = r"^\s*(?:--\s*|regards[,!]?|best(?: regards)?[,!]?|sincerely[,!]?|thanks[,!]?)\s*$"
MESSAGE_KINDS = (
    ("QUOTE_REVISION", r"\b(revised|updated|correction|supersedes|disregard previous|final quotation)\b"),
    ("NEGOTIATION", r"\b(can you|could you|best we can|reduce|lower price|negotia)"),
    ("QUOTE", r"\b(quote|quotation|unit price|pricing)\b"),
    ("RFQ_RESPONSE", r"\b(request for quote|rfq response)\b"),
    ("ORDER_CONFIRMATION", r"\b(order confirmation|confirmed order)\b"),
)
COMPANY_WORDS = (
    "supply", "supplies", "industrial", "industries", "manufacturing", "component", "components", "controls", "technical", "systems", "automation", "engineering", "company",
    "co", "corp", "inc", "incorporated", "llc", "ltd", "gmbh",
)


def split_history(body: Column) -> Column:
    """``struct(body, history)``: a message before and from the first line that starts quoted history."""
    return _cut(F.regexp_replace(_text(body), "\r\n?", "\n"), f"(?i){'|'.join(HISTORY)}", 0, "body", "history")


def split_signature(body: Column) -> Column:
    """``struct(body, signature)``: before and from the first line, but the very first, that starts a signature."""
    return _cut(body, f"(?i){SIGNATURE}", 1, "body", "signature")


def _cut(text: Column, start: str, least: int, head: str, tail: str) -> Column:
    """Before and from the first line that matches, not counting the first ``least`` ones."""
    lines = F.split(_text(text), "\n")
    at = F.array_position(F.transform(lines, lambda x, i: (i >= least) & x.rlike(start)), True).cast("int")
    before = F.when(at == 0, lines).otherwise(F.slice(lines, 1, F.greatest(at - 1, F.lit(0))))
    after = F.when(at == 0, F.array().cast("array<string>")).otherwise(F.slice(lines, F.greatest(at, F.lit(1)), F.size(lines)))
    join = lambda x: F.regexp_replace(F.array_join(x, "\n"), r"^\s+|\s+$", "")
    return F.struct(join(before).alias(head), join(after).alias(tail))


def classify_email(subject: Column, body: Column) -> Column:
    """The first kind whose words the subject or body has; without any, informational if there is a body."""
    text = F.lower(F.concat(_text(subject), F.lit("\n"), _text(body)))
    out = F.when(_text(body).rlike(r"\S"), "INFORMATIONAL").otherwise("UNKNOWN")
    for kind, words in reversed(MESSAGE_KINDS):
        out = F.when(text.rlike(words), kind).otherwise(out)
    return out


def identity_name(sender: Column, signature: Column, domain: Column) -> Column:
    """The name of a sender's company: the last signature line with a company word (no address or phone number), else
    the sender if it has one, else the stem of an own domain in title case, else the sender."""
    word = rf"(?i)\b({'|'.join(COMPANY_WORDS)})\b"
    lines = F.transform(F.split(_text(signature), "\n"), lambda x: F.btrim(F.regexp_replace(x, r"\s+", " "), F.lit(" ,|-")))
    good = F.filter(lines, lambda x: F.length(x).between(2, 200) & x.rlike(word) & ~F.contains(x, F.lit("@")) & ~x.rlike(r"\+?\d[\d ()-]{6}"))
    stem = F.initcap(F.replace(F.substring_index(domain, ".", 1), F.lit("-"), F.lit(" ")))
    own = (_text(domain) != "") & ~domain.isin(*GENERIC_DOMAINS)
    return F.coalesce(F.try_element_at(good, F.lit(-1)), F.when(sender.rlike(word) | ~F.coalesce(own, F.lit(False)), F.trim(_text(sender))), stem)


def row_label(s: Column) -> Column:
    """The first cell of a JSON array, else the text before the first : | or comma."""
    return F.trim(F.coalesce(F.when(s.startswith("["), F.get_json_object(s, "$[0]")), F.regexp_extract(_text(s), r"^([^:|,]*)", 1)))
