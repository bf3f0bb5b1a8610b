"""Text functions as columns: cleaning, keys, names, accessions, identifiers. No Python UDFs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(c: Column) -> Column:
    """Null becomes "", outer blanks go."""
    return F.trim(F.coalesce(c, F.lit("")))


def first_present(*cols: Column) -> Column:
    """The first value that is not blank, trimmed; "" if none is."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cols], F.lit(""))


def label_blank(c: Column, label: str) -> Column:
    """Blank or null becomes `label`."""
    return F.when(clean(c) == "", F.lit(label)).otherwise(clean(c))


def slug(c: Column) -> Column:
    """Lower case, runs of other signs than letters and digits as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def key_form(c: Column) -> Column:
    """Species key: trimmed, blanks collapsed, lower case."""
    return F.lower(F.regexp_replace(F.trim(c), r"\s+", " "))


def display_species(c: Column) -> Column:
    """"Genus epithet" (or the genus alone) for display: blanks collapsed, a subgenus in parentheses dropped; "" if the first word is not capitalised."""
    s = F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"\s+", " ")
    s = F.trim(F.regexp_replace(s, r"^(\S+)\s+\([^)]*\)\s*", "$1 "))
    genus, epithet = F.regexp_extract(s, r"^(\S+)", 1), F.regexp_extract(s, r"^\S+ ([^(\s]\S*)", 1)
    return F.when(~s.rlike(r"^\p{Lu}"), F.lit("")).otherwise(F.trim(F.concat_ws(" ", genus, epithet)))


def genus_of(c: Column) -> Column:
    return F.regexp_extract(F.trim(F.coalesce(c, F.lit(""))), r"^(\S+)", 1)


def is_binomial(c: Column) -> Column:
    return F.coalesce(F.size(F.split(F.trim(c), r"\s+")) >= 2, F.lit(False)) & (clean(c) != "")


def canonical_binomial(c: Column) -> Column:
    """"Genus epithet" if the first two words have these forms and the second is no rank marker, else null."""
    s = F.regexp_replace(F.trim(c), r"\s+", " ")
    ok = s.rlike(r"^\p{Lu}\p{Ll}+(?:-\p{Ll}+)? \p{Ll}[\p{Ll}-]+") & ~s.rlike(r"^\S+ (?:sp|spp|subsp|ssp|var|cf|aff|nr|indet|x|f)\b\.?")
    return F.when(ok, F.regexp_extract(s, r"^(\S+ \S+)", 1))


def accession_tokens(c: Column) -> Column:
    """array<string>: distinct valid accessions of a multi-value text, versions stripped, in order of appearance.

    Valid: 5 to 25 of A-Z, 0-9 and _, with a letter and a digit."""
    parts = F.transform(F.split(F.upper(F.coalesce(c, F.lit(""))), r"[|;,\s]+"), lambda x: F.regexp_replace(x, r"\.[0-9]+$", ""))
    return F.array_distinct(F.filter(parts, lambda x: x.rlike(r"^[A-Z0-9_]{5,25}$") & x.rlike("[A-Z]") & x.rlike("[0-9]")))


def accession_aliases(c: Column) -> Column:
    """The accession and its form with, or without, the NZ_ prefix."""
    return F.array(c, F.when(c.startswith("NZ_"), F.substring(c, 4, 100)).otherwise(F.concat(F.lit("NZ_"), c)))


def doi(c: Column) -> Column:
    """Lower-case bare DOI without resolver or scheme, or "" if there is none."""
    s = F.regexp_replace(F.lower(clean(c)), r"^(?:https?://)?(?:dx\.)?doi\.org/|^doi:\s*", "")
    return F.when(s.rlike(r"^10\.\d{4,9}/\S+$"), F.regexp_replace(s, r"[.,;)\]]+$", "")).otherwise(F.lit(""))


def publication_key(doi_text: Column, prefix: str, fallback: Column) -> Column:
    """"doi:..." where there is one, else "prefix:id", else null."""
    d, f = doi(doi_text), clean(fallback)
    return F.when(d != "", F.concat(F.lit("doi:"), d)).when(f != "", F.concat(F.lit(prefix + ":"), f))


def is_inchikey(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[A-Z]{14}-[A-Z]{10}-[A-Z]$"), F.lit(False))


def uuid_or_null(c: Column) -> Column:
    s = F.lower(F.trim(c))
    return F.when(s.rlike(r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"), s)


def person_tokens(c: Column) -> Column:
    """Distinct names of a collectors text split at & ; , and "and": at least two letters, no digits, not all initials."""
    s = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)\s+and\s+|[&;|]", ",")
    parts = F.transform(F.split(s, ","), lambda x: F.regexp_replace(F.trim(x), r"\s+", " "))
    return F.array_distinct(F.filter(parts, lambda x: x.rlike(r"\p{L}{2,}") & ~x.rlike(r"\d")))


def institution_form(c: Column, replacements: dict[str, str]) -> Column:
    """Lower case, parentheses dropped, the literal replacements applied in order, blanks collapsed."""
    s = F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"\([^)]*\)", " "))
    s = reduce(lambda acc, kv: F.replace(acc, F.lit(kv[0]), F.lit(kv[1])), replacements.items(), s)
    return F.trim(F.regexp_replace(s, r"[\s,.]+", " "))


def iso3_or_null(c: Column) -> Column:
    """The first of a ;-list, if it is three capitals."""
    s = F.trim(F.element_at(F.split(F.coalesce(c, F.lit("")), ";"), 1))
    return F.when(s.rlike("^[A-Z]{3}$"), s)


def first_keyword(c: Column, rules: list[tuple[str, str]], default: str = "") -> Column:
    """The code of the first rule (in the order given) whose keyword the lower-cased text contains."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.coalesce(*[F.when(low.contains(k), F.lit(v)) for k, v in rules], F.lit(default))


def has_word(c: Column, word: str) -> Column:
    """Whole word, any case."""
    return F.coalesce(c.rlike(rf"(?i)\b{word}\b"), F.lit(False))


def compact_number(c: Column) -> Column:
    """1234567 as 1.2M, 3400 as 3.4K, smaller ones as they are."""
    x = c.cast("double")
    return F.when(x >= 1_000_000, F.format_string("%.1fM", x / 1_000_000)).when(x >= 1_000, F.format_string("%.1fK", x / 1_000)).otherwise(F.format_string("%d", c.cast("long")))


def latex(c: Column) -> Column:
    """The signs & % $ # _ { } escaped."""
    return F.regexp_replace(c, r"([&%$#_{}])", r"\\$1")


def joined_key(*cols: Column) -> Column:
    return F.concat_ws("_", *cols)


def record_key(ids: list[Column], row: list[Column]) -> Column:
    """The first id that is not blank, else a digest of the whole row."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in ids], F.md5(F.concat_ws("\x1f", *[F.coalesce(c, F.lit("")) for c in row])))


def snake_case(name: str) -> str:
    """A column name as snake_case (driver helper)."""
    import re

    return re.sub(r"[^a-z0-9]+", "_", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()).strip("_")


def scraped(html: Column, pattern: str, group: int = 1) -> Column:
    """All matches of a pattern in markup, with the five basic entities and &nbsp; read."""
    plain = html
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(sign))
    return F.regexp_extract_all(plain, F.lit(pattern), F.lit(group))


def split_rows(c: Column, sep: str) -> Column:
    """array<string>: trimmed non-empty parts, order kept (explode or posexplode it)."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), sep), lambda x: F.trim(x)), lambda x: x != "")


def mapped(c: Column, table: dict[str, str], default: str | None = None) -> Column:
    """A literal dictionary applied to a column; `default` for what it does not hold and for null."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, c), F.lit(default))
