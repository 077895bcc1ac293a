"""Text functions on columns; the patterns hold for Java and RE2 alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, with the four separators that only some languages count.
BLANKS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
BLEU_TOKEN = r"[A-Za-z0-9]+(?:['-][A-Za-z0-9]+)?|[^\p{L}\p{N}_\s]"

# Texts that stand for deleted ones; words that don't count for overlap; words of no information.
GONE = ("[deleted]", "[removed]", "deleted", "removed")
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "do", "for", "from", "have", "i", "if", "in", "is", "it", "its", "just", "me", "my", "not", "of", "on", "or",
    "really", "so", "that", "the", "their", "them", "there", "they", "this", "to", "was", "with", "you", "your",
)
LOW_SIGNAL = ("card", "cards", "credit", "really", "would", "should", "could", "people", "thing", "things")

#: Ends of a word in any alphabet.
EDGE = (r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])")

# Patterns of the style signals, on lower-cased text.
STYLE_PATTERNS = {
    "personal datapoints": EDGE[0] + "(i|i'm|i’ve|i've|my|me|we|our|us)" + EDGE[1],
    "skeptical or probing questions": r"\?",
    "snark or aggressive language": EDGE[0] + "(lol|lmao|wtf|shit|hell|stupid|dumb|garbage|trash|rip)" + EDGE[1],
    "calm practical advice": EDGE[0] + "(depends|if you|worth|keep|use|works|unless|better)" + EDGE[1],
}

# Brands by host.
BRAND_HOSTS = {
    "americanexpress.com": "American Express", "chase.com": "Chase", "creditcards.chase.com": "Chase", "capitalone.com": "Capital One",
    "bankofamerica.com": "Bank of America", "citicards.citi.com": "Citi", "citi.com": "Citi", "discover.com": "Discover",
    "wellsfargo.com": "Wells Fargo", "creditcards.wellsfargo.com": "Wells Fargo", "usbank.com": "U.S. Bank", "barclaycardus.com": "Barclays",
    "synchrony.com": "Synchrony", "chime.com": "Chime", "openskycc.com": "OpenSky", "dcu.org": "DCU", "firstcard.app": "Firstcard",
    "current.com": "Current", "self.inc": "Self", "choicehotels.com": "Choice Privileges", "bestwestern.com": "Best Western",
    "penfed.org": "PenFed", "wyndhamhotels.com": "Wyndham", "hyatt.com": "World of Hyatt", "aeroplan.com": "Aeroplan",
    "aa.com": "American Airlines", "delta.com": "Delta", "united.com": "United", "hiltonhonors.com": "Hilton Honors",
    "southwest.com": "Southwest", "primevisa.com": "Prime Visa",
}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_text(c: Column | str) -> Column:
    """White space collapsed and trimmed; null and stand-ins for deleted texts become empty."""
    t = F.trim(F.regexp_replace(F.coalesce(_col(c), F.lit("")), BLANKS, " "))
    return F.when(F.lower(t).isin(*GONE), F.lit("")).otherwise(t)


def word_count(clean: Column | str) -> Column:
    """Words of a cleaned text, split at blanks."""
    c = _col(clean)
    return F.when(c == "", F.lit(0)).otherwise(F.size(F.split(c, " ")))


def is_usable(clean: Column | str, least: int = 2) -> Column:
    return word_count(clean) >= least


def truncate(c: Column | str, n: int) -> Column:
    """Compacted text, cut to n characters with an ellipsis."""
    t = F.trim(F.regexp_replace(F.coalesce(_col(c), F.lit("")), BLANKS, " "))
    return F.when(F.length(t) > n, F.concat(F.rtrim(F.substring(t, 1, n - 1)), F.lit("…"))).otherwise(t)


def sanitize(c: Column | str) -> Column:
    """Control characters become blanks."""
    return F.regexp_replace(_col(c), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", " ")


def canonical_label(c: Column | str) -> Column:
    s = F.regexp_replace(F.lower(_col(c)), "[^a-z0-9]+", "_")
    return F.regexp_replace(s, "^_+|_+$", "")


def bleu_tokens(c: Column | str) -> Column:
    """Lower-cased tokens: ASCII alphanumerics with one inner ' or -, else single signs; other letters are dropped."""
    return F.transform(F.regexp_extract_all(_col(c), F.lit(BLEU_TOKEN), F.lit(0)), F.lower)


def overlap_tokens(c: Column | str) -> Column:
    """Lower-cased letters, digits and ' of each word, of 3 characters or more, without stop words."""
    words = F.split(F.trim(F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(_col(c), F.lit("")), "’", "'")), BLANKS, " ")), " ")
    bare = F.transform(words, lambda w: F.regexp_replace(F.regexp_replace(w, r"[^\p{L}\p{N}']+", ""), "^'+|'+$", ""))
    return F.filter(bare, lambda w: (F.length(w) >= 3) & ~w.isin(*STOPWORDS))


def retrieval_tokens(c: Column | str) -> Column:
    """The set of lower-case ASCII words of 2 characters or more."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.coalesce(_col(c), F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.length(w) >= 2))


def ngrams(tokens: Column | str, n: int) -> Column:
    t = _col(tokens)
    return F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.array_join(F.slice(t, i, n), " "))).otherwise(F.array().cast("array<string>"))


def brand_of_url(url: Column | str) -> Column:
    host = F.regexp_replace(F.lower(F.try_parse_url(_col(url), F.lit("HOST"))), r"^www\.", "")
    table = F.create_map(*[F.lit(x) for kv in BRAND_HOSTS.items() for x in kv])
    return F.try_element_at(table, host)


def is_informative(phrase_tokens: Column) -> Column:
    return F.exists(phrase_tokens, lambda w: ~w.isin(*LOW_SIGNAL))


def title_key(title: Column | str) -> Column:
    """Titles compared without case and with single blanks; null is empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(title) if isinstance(title, str) else title, F.lit(""))), r"\s+", " "))


def json_object(raw: Column) -> Column:
    """The JSON object in a text that may be fenced, have words around it, or commas before closing brackets; null if
    there is none. Nested objects stay within it."""
    bare = F.regexp_replace(F.trim(raw), r"(?im)^\s*```(?:json)?\s*$", "")
    fixed = lambda t: F.regexp_replace(t, r",\s*([}\]])", "$1")
    found = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    good = lambda t: F.when(F.try_parse_json(t).isNotNull() & t.startswith("{"), t)
    return F.coalesce(good(F.trim(bare)), good(F.trim(fixed(bare))), good(found), good(fixed(found)))


def json_or_content(info: Column) -> Column:
    """info if it is a JSON object, else an object whose content it is; null and empty info give an empty object."""
    return F.when(F.coalesce(F.trim(info), F.lit("")) == "", F.lit("{}")).when(F.try_parse_json(info).isNotNull() & F.trim(info).startswith("{"), info).otherwise(F.to_json(F.struct(info.alias("content"))))


def bounded(raw: Column, low: float, high: float, default: float) -> Column:
    """raw as a number between low and high; default where it is none."""
    x = raw.cast("string").try_cast("double")
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), F.when(x.isNull() | F.isnan(x), F.lit(float(default))).otherwise(x)))


def shown(x: Column, digits: int = 3) -> Column:
    """A number for display; n/a where there is none."""
    return F.when(x.isNull() | F.isnan(x), "n/a").otherwise(F.format_string(f"%.{digits}f", x))


def without_blank_runs(text: Column) -> Column:
    """Lines without trailing blanks, and never more than one empty line in a row."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"[ \t]+(?=\n|$)", ""), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")
