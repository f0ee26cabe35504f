"""Text columns: slugs, names, prices, tags and search tokens.  All are native expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN_ARTIST = "Artista não identificado"


def _fold_map() -> tuple[str, str]:
    """Characters of the Latin blocks whose decomposition starts with one ASCII character, with that; and bare accents, dropped."""
    plain = {chr(c): unicodedata.normalize("NFD", chr(c)) for r in (range(0xC0, 0x250), range(0x1E00, 0x1F00)) for c in r}
    plain = {k: v[0] for k, v in plain.items() if len(v) > 1 and v[0].isascii() and all(unicodedata.combining(x) for x in v[1:])}
    return "".join(plain) + "".join(map(chr, range(0x300, 0x370))), "".join(plain.values())


_FROM, _TO = _fold_map()
# The accent map of the compatible SQL slug; its second half is one character short, which shifts the letters from ö on.
_COMPAT_FROM = "áàâãäåéèêëíìîïóòõôöúùûüçñý"
_COMPAT_TO = "aaaaaaeeeeiiiioooouuuucny"


def fold(text: Column) -> Column:
    """Without accents."""
    return F.translate(text, _FROM, _TO)


def _slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def slug(text: Column) -> Column:
    """Lower case without accents, runs of anything else one hyphen, none at the ends."""
    return _slug(F.lower(fold(text)))


def uninvert(name: Column) -> Column:
    """"LAST, FIRST" to "FIRST LAST"; names with an empty side, or without comma, stay.  Further commas stay in the first name."""
    parts = F.split(name, ",", 2)
    last, first = F.trim(F.get(parts, 0)), F.trim(F.get(parts, 1))
    return F.when(name.contains(",") & (last != "") & (first != ""), F.concat(first, F.lit(" "), last)).otherwise(name)


def artist_slug(name: Column) -> Column:
    """The slug of the name in reading order, 60 characters at most."""
    return F.left(slug(uninvert(name)), F.lit(60))


def style_slug(tag: Column) -> Column:
    return slug(tag)


def compat_slug(text: Column) -> Column:
    """The slug as the SQL of the original system makes it (see the note on the map); for lookups of stored values only."""
    return _slug(F.translate(F.lower(text), _COMPAT_FROM, _COMPAT_TO))


def compat_inverted_slug(text: Column) -> Column:
    """The same for "LAST, FIRST": the second and first parts between commas, any others ignored."""
    part = lambda n: F.trim(F.split_part(text, F.lit(","), F.lit(n)))
    return compat_slug(F.concat(part(2), F.lit(" "), part(1)))


def product_slug(title: Column, key: Column) -> Column:
    """The slug of the first 80 characters of the title and the last 6 of the key."""
    return F.concat_ws("-", F.nullif(slug(F.left(title, F.lit(80))), F.lit("")), F.lower(F.right(key, F.lit(6))))


# Words that stay small inside a name.
SMALL_WORDS = ("of", "the", "and", "or", "in", "on", "at", "to", "a", "an", "de", "da", "do", "e", "y", "los", "las", "el", "la")


def title_case(name: Column) -> Column:
    """Each word capitalised, connecting words small unless they come first."""
    words = F.filter(F.split(name, r"\s+"), lambda w: w != "")
    cased = F.transform(words, lambda w, i: F.when((i > 0) & F.lower(w).isin(*SMALL_WORDS), F.lower(w)).otherwise(F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substring(w, 2, 1_000_000)))))
    return F.array_join(cased, " ")


def normalize_artist(name: Column) -> Column:
    """Inverted names in reading order and title case; names of more than four letters, all capitals, in title case."""
    letters = F.regexp_replace(name, r"[^\p{L}]", "")
    capitals = (F.length(letters) > 4) & ~letters.rlike(r"[^\p{Lu}]")
    inverted = uninvert(name)
    return F.when(name.isNull() | (name == "") | (name == UNKNOWN_ARTIST), name).when(inverted != name, title_case(inverted)).when(capitals, title_case(name)).otherwise(name)


# Phrases that are never an artist.
REJECTED_PHRASES = (
    "ouça com amazon music", "ouça com music unlimited", "listen with amazon music", "adicionar ao carrinho", "add to cart", "comprar agora", "buy now",
    "prime", "frete grátis", "em estoque", "disponível", "vendido por", "sold by", "patrocinado", "sponsored", "em até", "in up to", "x de r$", "x r$", "sem juros",
    "compras no mês", "compras nos últimos", "bought in past", "bought last month", "amazon music", "oferta", "mais opções de comprar", "opções de comprar", "dias de",
    "página", "preço", "r$", "outro formato", "other format",
)


# Patterns of names, titles, prices and pages.
LEADING_WORD, EDGE_SIGNS, YEAR_PART = r"(?i)^(por|by|de)(?=\s|[^a-zA-ZÀ-ÿ])", "^[:·•–—,;]+|[:·•–—,;]+$", r"\s*\|\s*\d{4}\b.*$"
CD_TITLE = r"(?i)\bcd\b|\[cd\]|\(cd\)|compact disc|\bcd\s*\d"
FORMAT_LABEL, TITLE_EDGES = r"(?i)\s*[\[(]\s*(?:disco\s+de\s+vinil|vinil|vinyl|\d*\s*lp|picture\s+disc|180\s*g[r]?)\s*[\])]\s*", r"^[ \-–—|,]+|[ \-–—|,]+$"
PRICE_SIGNS, PRICE_NUMBER = r"R\$\s*|\x{A0}|\s", r"\d+(?:\.\d+)?"

# What pages say that ask whether the reader is human; case is ignored.
ROBOT_PATTERNS = (
    r"Robot Check", r"Verificação de robô", r"Digite os caracteres", r"just need to make sure you.re not a robot", r"automated access to Amazon",
    r"Access Denied", r"Enter the characters you see", r"validateCaptcha", r"Prove you.re not a robot",
)


def plausible_artist(name: Column) -> Column:
    """Whether a text can be an artist: a letter, 120 characters at most, no price, no phrase of the shop."""
    low = F.lower(name)
    clean = F.lit(True)
    for phrase in REJECTED_PHRASES:
        clean = clean & ~low.contains(phrase)
    return F.coalesce((F.length(name) <= 120) & name.rlike("[a-zA-ZÀ-ÿ]") & ~name.rlike(r"^R\$|^\$|^\d+[.,]") & clean & ~name.rlike(r"\d+[,.]\d{2}"), F.lit(False))


def clean_artist(text: Column) -> Column:
    """Without a leading por/by/de, punctuation at the ends and a trailing "| year ..."."""
    t = F.trim(F.regexp_replace(F.trim(text), LEADING_WORD, ""))
    t = F.trim(F.regexp_replace(t, EDGE_SIGNS, ""))
    return F.trim(F.regexp_replace(t, YEAR_PART, ""))


def vinyl_title(title: Column) -> Column:
    """Not a CD by its title."""
    return ~title.rlike(CD_TITLE)


def blocked_page(html: Column) -> Column:
    """A page that asks whether the reader is a robot."""
    return html.rlike(f"(?iu){'|'.join(ROBOT_PATTERNS)}")


def parse_price(text: Column) -> Column:
    """A price as written in Brazil: points group thousands, a comma starts the cents.  So "29.90" is 2990."""
    bare = F.regexp_replace(text, PRICE_SIGNS, "")
    return F.nullif(F.regexp_extract(F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit(".")), PRICE_NUMBER, 0), F.lit("")).try_cast("double")


def parse_review_count(text: Column) -> Column:
    """The first number, points and commas being separators; null unless above 0."""
    n = F.nullif(F.regexp_replace(F.regexp_extract(text, r"[\d.,]+", 0), "[.,]", ""), F.lit("")).try_cast("int")
    return F.when(n > 0, n)


def parse_rating(text: Column) -> Column:
    """"x de 5", "x out of 5" or "x estrelas": 0 to 5, one decimal."""
    found = F.regexp_extract(text, r"(?i)([\d,.]+)\s*(?:de\s*5|out\s*of\s*5|estrelas)", 1)
    value = F.nullif(F.replace(found, F.lit(","), F.lit(".")), F.lit("")).try_cast("double")
    return F.when(value.between(0, 5), F.floor(value * 10 + 0.5) / 10)


def image_size(url: Column, mark: str = "AC_SX300") -> Column:
    """The image address with another size mark."""
    return F.regexp_replace(url, r"\._[A-Z0-9_,]+_\.", f"._{mark}_.")


def key_of_url(url: Column) -> Column:
    """The ten signs behind /dp/, upper case; null if there are none."""
    return F.nullif(F.upper(F.regexp_extract(url, r"(?i)/dp/([A-Z0-9]{10})", 1)), F.lit(""))


def product_url(key: Column, tag: str, base: str = "https://shop.example.com/dp/") -> Column:
    return F.concat(F.lit(base), key, F.lit(f"?tag={tag}"))


def page_url(url: Column, page: Column) -> Column:
    """The address of a page of a listing, with any former page and session numbers taken out; the first page has no number."""
    bare = F.regexp_replace(url, r"[&?](?:page|qid)=\d+", "")
    return F.when(page == 1, bare).otherwise(F.concat(bare, F.when(bare.contains("?"), "&").otherwise("?"), F.lit("page="), page.cast("string")))


def clean_title(title: Column) -> Column:
    """Without format labels in brackets, and without separators at the ends."""
    return F.regexp_replace(F.regexp_replace(title, FORMAT_LABEL, " "), TITLE_EDGES, "")


def escape_html(text: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def brl(value: Column) -> Column:
    """1234.56 as 1.234,56."""
    return F.translate(F.format_number(value, 2), ",.", ".,")


def parse_tags(tags: Column) -> Column:
    """The tags of a comma-joined list, trimmed, empty ones dropped (null: none)."""
    return F.coalesce(F.filter(F.transform(F.split(tags, ","), lambda t: F.trim(t)), lambda t: t != ""), F.expr("cast(array() as array<string>)"))


def stored_tags(tags: Column) -> Column:
    """The lower-case elements of a list joined by ", ", as stored; null stays null."""
    return F.split(F.lower(tags), ", ")


def capitalize_words(text: Column) -> Column:
    """The first letter of every run of word characters in upper case, the others as they are."""
    parts = F.regexp_extract_all(text, F.lit(r"\w+|\W+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.substring(p, 2, 1_000_000))), "")


def truncate_title(text: Column, limit: int = 60) -> Column:
    """A title above limit characters is cut before its last " | ", or at the limit if it has none."""
    cut = F.regexp_extract(text, r"(?s)^(.*) \| ", 1)
    return F.when(F.length(text) <= limit, text).when(text.contains(" | "), cut).otherwise(F.left(text, F.lit(limit)))


def truncate_description(text: Column, limit: int = 155) -> Column:
    """A description above limit characters is cut there, at its last blank if there is one, with an ellipsis."""
    cut = F.left(text, F.lit(limit))
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.regexp_replace(cut, "(?s)(?<=.) [^ ]*$", ""), F.lit("…")))


def numbers_of_json(text: Column) -> Column:
    """The numbers of a JSON array, in order, without those that are none; null and blank texts are 0, bad JSON is an empty list."""
    values = F.transform(F.from_json(text, "array<string>"), lambda x: F.when(F.trim(F.coalesce(x, F.lit(""))) == "", 0.0).otherwise(x.try_cast("double")))
    return F.coalesce(F.filter(values, lambda x: x.isNotNull() & ~F.isnan(x)), F.expr("cast(array() as array<double>)"))


def search_prefixes(term: str) -> list[str]:
    """The lower-case words of a search term, stripped of anything but letters and digits; empty ones dropped."""
    kept = ["".join(c for c in word if c.isascii() and c.isalnum() or "À" <= c <= "ɏ") for word in term.split()]
    return [w.lower() for w in kept if w]


def tokens(text: Column) -> Column:
    """The words of a text in lower case, accents kept."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def _begins(prefix: str):
    return lambda word: word.startswith(prefix)


def matches_all(words: Column, prefixes: list[str]) -> Column:
    """Whether every prefix begins some word."""
    hit = F.lit(True)
    for p in prefixes:
        hit = hit & F.exists(words, _begins(p))
    return hit


def search_rank(artist: Column, title: Column, prefixes: list[str]) -> Column:
    """1.0 for each word of the artist and 0.4 for each of the title that a prefix begins."""
    hits = lambda text: F.size(F.filter(tokens(text), lambda w: F.exists(F.array(*map(F.lit, prefixes)), lambda p: w.startswith(p)))) if prefixes else F.lit(0)
    return hits(artist) * 1.0 + hits(title) * 0.4


def contains_text(column: Column, term: str) -> Column:
    """Whether a text holds the term, case ignored; percent, underscore and backslash are plain characters."""
    return F.lower(column).contains(term.lower())
