"""Pieces of SQL that several queries share."""

from veldspaat.functions.text import FURNITURE, SPACE, STOPWORDS, TOKEN

STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


def tokens(text: str) -> str:
    """A list of retrieval tokens."""
    words = f"list_filter(regexp_extract_all(lower(coalesce({text}, '')), '{TOKEN}'), lambda w: length(w) > 1 and w not in ({STOP}))"
    return f"list_transform({words}, lambda w: case when length(w) > 6 then regexp_replace(w, '(ingen|heden|en|er|s)$', '') else w end)"


def collapse(text: str) -> str:
    return f"trim(regexp_replace({text}, '{SPACE}+', ' ', 'g'))"


def joined(*columns: str) -> str:
    return " || ' ' || ".join(f"coalesce(cast({c} as varchar), '')" for c in columns)


def clean(text: str) -> str:
    """Cleaning in SQL; hyphens are joined twice, as a letter between two of them belongs to both."""
    out = f"replace(replace(replace(regexp_replace(nfc_normalize({text}), '[' || chr(173) || chr(65279) || ']', '', 'g'), 'T errorisme', 'Terrorisme'), 'T otale', 'Totale'), 'T eruggevonden', 'Teruggevonden')"
    out = f"array_to_string(list_transform(list_filter(string_split({out}, chr(10)), lambda r: not regexp_matches(r, '{FURNITURE}')), lambda r: regexp_replace(r, '{SPACE}+$', '')), chr(10))"
    for _ in range(2):
        out = f"regexp_replace({out}, '([a-zà-öø-ÿ])-\\n([a-zà-öø-ÿ])', '\\1\\2', 'g')"
    return f"regexp_replace(regexp_replace({out}, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
