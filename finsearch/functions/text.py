"""Text expressions: cleaning, tokens, stop words, previews."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

# The English stop words of the common 127-word list.
STOPWORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers "
    "herself it its itself they them their theirs themselves what which who whom this that these those am is are "
    "was were be been being have has had having do does did doing a an the and but if or because as until while "
    "of at by for with about against between into through during before after above below to from up down in out "
    "on off over under again further then once here there when where why how all any both each few more most "
    "other some such no nor not only own same so than too very s t can will just don should now"
).split()

# Named character entities of HTML 4, from the standard library; the no-break space is a space.
ENTITIES = {name: chr(code) for name, code in sorted(name2codepoint.items())} | {"apos": "'", "nbsp": " "}

TOKEN_GAP = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Lowercased words in order; gaps at the ends leave empty strings, so positions stay stable."""
    return F.split(F.lower(text), TOKEN_GAP)


def is_indexed(word: Column, stopwords: list[str] | tuple[str, ...]) -> Column:
    """Whether a word is kept by the index."""
    kept = word != ""
    return kept & ~word.isin(*stopwords) if stopwords else kept


def html_to_text(html: Column) -> Column:
    """Plain text of an HTML page: no scripts, styles, comments or tags; entities decoded."""
    text = F.regexp_replace(html, r"(?is)<script\b[^>]*>.*?</script\s*>", " ")
    text = F.regexp_replace(text, r"(?is)<style\b[^>]*>.*?</style\s*>", " ")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    text = _references(text)
    return F.trim(F.regexp_replace(text, r"[\s\x{00A0}]+", " "))


def _references(text: Column) -> Column:
    """Decode ``&eacute;``, ``&#8217;`` and ``&#x2019;``: cut before each ampersand, decode the head of each piece once.

    Unknown names stay as they are. Numbers beyond Unicode, surrogates and zero become U+FFFD.
    """
    names = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])

    def decode(piece: Column) -> Column:
        head = F.regexp_extract(piece, r"^&(#0*[0-9]+|#[xX]0*[0-9A-Fa-f]+|[A-Za-z0-9]+);", 1)
        digits = F.regexp_extract(head, r"^#0*([0-9]{1,7})$", 1)
        hexa = F.regexp_extract(head, r"^#[xX]0*([0-9A-Fa-f]{1,6})$", 1)
        code = F.when(digits != "", digits.cast("long")).when(hexa != "", F.conv(hexa, 16, 10).cast("long"))
        known = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        number = F.when(known, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(F.lit("\ufffd"))
        char = F.when(head.startswith("#"), number).otherwise(F.try_element_at(names, head))
        rest = piece.substr(F.length(head) + 3, F.length(piece))
        return F.when((head != "") & char.isNotNull(), F.concat(char, rest)).otherwise(piece)

    pieces = F.split(text, "(?=&)")
    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(pieces, decode), "")).otherwise(text)


def preview(text: Column, length: int = 60) -> Column:
    """The first characters followed by dots."""
    return F.concat(F.substring(text, 1, length), F.lit("..."))


def route_query(text: Column) -> Column:
    """A text with a space or a lowercase letter is a question, anything else a ticker."""
    return F.when(text.rlike(r"[ \p{Ll}]"), F.lit("semantic")).otherwise(F.lit("ticker"))


def document_type(accession: Column) -> Column:
    """Form name from the accession number."""
    return F.when(F.lower(accession).contains("13f"), "Form 13F").otherwise("Form 10-K")
