"""Fixed values that must equal the reference's for equal results."""

# Regular expressions of the cleaning and evaluation filters.
# Tail of a tag to strip: "+digits", a double quote and the rest, a semicolon and the rest.
TAG_TAIL = r'(?:\+[0-9]+|\".*|;.*)+$'
# R2: a word starting with one of these characters is dropped.
LEADING_PUNCT = r"^(?:\"|!|'|,|\.|\?|:|;|\||\-|\+|\(|\)|\[|\]|\{|\}|%|\*|/|&|=|>|<|_|\s)"
# Evaluated words start with a Cyrillic letter (U+0400 to U+04FF).
CYRILLIC_START = "^[Ѐ-ӿ]"
# Tags excluded from evaluation: proper nouns, H, punct (case-insensitive).
EXCLUDED_TAGS = r"(?i)^(?:Np|H|punct)"
# Script class used by the derived Latin-script test corpus.
LATIN_START = "^[A-Za-zÀ-ÿ]"

# Strings read as missing by default (pandas' default NA list).
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
)
