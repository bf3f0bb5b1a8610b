"""Several values packed in one field: one row per value, its position kept.

Fields are written in many dialects (which characters separate, whether values are quoted or bracketed), often
mixed within a column. The dialect of a text is the one that describes it in the fewest bits: a parse costs the
code lengths of its values' shapes (minus log2 of their share among all values of the column), the separators it
spends and the quotes it leaves unexplained. Texts are first reduced to shapes (words become `w`, punctuation
stays), so that all scoring happens on the few distinct shapes with their counts; these tables are distributed
aggregates and are joined back to the texts by shape. Each text is then split with its cheapest dialect.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.skew import maybe_broadcast
from gridloom.storage import checkpointed, written

#: Stand-ins for the word "and" between blanks, and for a comma inside one name.
AND, COMMA = "\x01", "\x03"


@dataclass(frozen=True)
class Dialect:
    """separators: single characters; quote: "" for none; brackets: a pair around the whole text is dropped."""

    separators: str
    quote: str = '"'
    brackets: bool = False

    @property
    def name(self) -> str:
        return f"{'b' if self.brackets else ''}{ {'': 'n', chr(34): 'd', chr(39): 's'}[self.quote] }:{self.separators}".replace("\n", "\\n").replace(AND, "and")


@dataclass(frozen=True)
class Grammar:
    """The dialects a field may be written in; persons: a comma in "Surname, Given" does not separate."""

    dialects: tuple[Dialect, ...]
    persons: bool = False


def _dialects(sets: tuple[str, ...]) -> tuple[Dialect, ...]:
    plain = [Dialect(s, q) for s in sets for q in ('"', "'", "")]
    return tuple(plain + [Dialect(s, q, True) for s in sets for q in ('"', "'")])


PERSONS = Grammar(_dialects(("", ";|\n", f";|\n/&+{AND}", f";|\n/&+{AND},")), persons=True)
CODES = Grammar(_dialects(("", ";|\n", ",;|\n", ",;|\n ")))

_HARD = rf"[;|\n/&+{AND}]"
_WORD = rf"[^\s,;|/&+\"{AND}]+"


def _prepared(text: Column, grammar: Grammar) -> Column:
    """The text with "and" and name-internal commas replaced by single characters."""
    if not grammar.persons:
        return text
    text = F.regexp_replace(text, r"(?i)(?<=[\s,;])and(?=\s)", AND)
    return F.regexp_replace(text, rf"(?<=^|{_HARD})(\s*{_WORD}\s*),(\s*{_WORD}\s*)(?=$|{_HARD})", f"$1{COMMA}$2")


def _restored(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, AND, "and"), COMMA, ",")


def _shape(prepared: Column) -> Column:
    """Words as `w`, runs of blanks as one; separators, quotes and brackets as they are."""
    return F.regexp_replace(F.regexp_replace(prepared, r"[\p{L}\p{M}\p{N}._:#’-]+(?:(?<=\p{L})'(?=\p{L})[\p{L}\p{M}\p{N}._:#’-]+)*", "w"), r"[ \t\r\f]+", " ")


def _parse(prepared: Column, d: Dialect) -> Column:
    """array<string>: the non-empty values of a prepared text, quotes and brackets still to be cleaned."""
    if d.brackets:
        prepared = F.regexp_replace(F.regexp_replace(prepared, r"^\s*[\[{(]", ""), r"[\]})]\s*$", "")
    cls = "".join("\\" + c if c in "|&+[]^-\\/" else c for c in d.separators)
    stop = f"[{cls}]" if cls else "(?!)"
    unquoted = f"[^{cls}]+" if cls else r"[\s\S]+"
    if d.quote:
        q = d.quote
        blank = r"[^\S\n]*" if "\n" in d.separators else r"\s*"
        if " " in d.separators:
            blank = ""
        # Unrolled: no alternation is repeated, so that long texts need no deep recursion.
        pattern = rf"(?s){blank}{q}[^{q}]*(?:{q}{q}[^{q}]*)*{q}{blank}(?={stop}|$)|{unquoted}"
    else:
        pattern = f"(?s){unquoted}"
    return F.filter(F.regexp_extract_all(prepared, F.lit(pattern), F.lit(0)), lambda v: F.trim(F.regexp_replace(v, r"\s", "")) != "")


def _clean(value: Column, quote: str, lines: bool = False) -> Column:
    """Outer blanks, enclosing quotes (doubled ones inside become one) and enclosing brackets removed, inner blanks run
    as one; lines: line ends stay, as marks that a shape still shows."""
    v = F.trim(value) if lines else F.trim(F.regexp_replace(value, r"\s+", " "))
    if quote:
        inside = F.trim(F.regexp_replace(v.substr(F.lit(2), F.length(v) - 2), quote * 2, quote))
        v = F.when((F.length(v) >= 2) & v.startswith(quote) & v.endswith(quote), inside).otherwise(v)
    bracketed = F.trim(v.substr(F.lit(2), F.length(v) - 2))
    return F.when(v.rlike(r"^(?:\[[^\[\]]*\]|\{[^{}]*\}|\([^()]*\))$"), bracketed).otherwise(v)


def _values(prepared: Column, d: Dialect) -> Column:
    cleaned = F.transform(_parse(prepared, d), lambda v: _restored(_clean(v, d.quote)))
    return F.filter(cleaned, lambda v: v != "")


def _base_bits(shape: Column, grammar: Grammar) -> Column:
    """Code length of a value's shape before any counts are known: 1.5 bits a character, 6 more for one that could
    have separated, 20 more for a quote or bracket that was not taken off."""
    could = "".join(sorted({c for d in grammar.dialects for c in d.separators}))
    cls = "".join("\\" + c if c in "|&+[]^-\\/" else c for c in could)
    separators = F.length(F.regexp_replace(shape, f"[^{cls}]", ""))
    marks = F.length(F.regexp_replace(shape, r"[^\"'\[\]{}]", ""))
    return 2.0 + 1.5 * F.length(shape) + 6.0 * separators + 20.0 * marks


def dialect_model(shapes: DataFrame, grammar: Grammar, rounds: int = 2) -> DataFrame:
    """One row per distinct text shape: shape_id (its digest), n_texts, dialect (its index in the grammar), bits.

    `shapes`: shape and shape_id, one row per text. Starts from a fixed code, then alternates: choose each shape's cheapest
    parse, count the value shapes of the chosen parses over all texts, code by these counts. Ties take the dialect listed
    first (fewest separators).
    """
    # The shapes, their parses and each round's choice are small tables of their own: the plans stay short.
    shapes = checkpointed(shapes.groupBy("shape_id").agg(F.first("shape").alias("shape"), F.count(F.lit(1)).alias("n_texts")))
    tries = F.array(*[F.struct(F.lit(i).alias("dialect"), _shape_values(F.col("shape"), d).alias("parsed")) for i, d in enumerate(grammar.dialects)])
    parses = shapes.select("shape_id", "n_texts", F.inline(tries))  # the digest, not the shape: a long one is not repeated per value
    values = parses.select("shape_id", "n_texts", "dialect", F.greatest(F.size("parsed") - 1, F.lit(0)).alias("n_separators"), F.explode_outer("parsed").alias("value_shape"))
    values = checkpointed(values)
    coded = values.withColumn("bits", _base_bits(F.coalesce("value_shape", F.lit("")), grammar))
    for step in range(rounds + 1):
        cost = coded.groupBy("shape_id", "n_texts", "dialect").agg((F.sum("bits") + F.first("n_separators")).alias("bits"))
        best = cost.groupBy("shape_id", "n_texts").agg(F.min(F.struct(F.round("bits", 6).alias("bits"), "dialect")).alias("best")).select("shape_id", "n_texts", "best.dialect", "best.bits")
        best = checkpointed(best)
        if step == rounds:
            return best
        chosen = values.join(best.select("shape_id", "dialect"), ["shape_id", "dialect"])
        counts = chosen.where(F.col("value_shape").isNotNull()).groupBy("value_shape").agg(F.sum("n_texts").alias("n"))
        total = counts.agg(F.sum("n").alias("n_all"))
        coded = (
            values.join(counts, "value_shape", "left")
            .crossJoin(F.broadcast(total))  # one row
            # The dictionary is part of the description: a shape's spelling is shared by all values that use it.
            .withColumn("n", F.coalesce("n", F.lit(1)))
            .withColumn("bits", F.log2((F.col("n_all") + 1) / F.col("n")) + _base_bits(F.coalesce("value_shape", F.lit("")), grammar) / F.col("n"))
        )


def _shape_values(shape: Column, d: Dialect) -> Column:
    """The shapes of a parse's values, repeats kept."""
    return F.transform(_parse(shape, d), lambda v: _clean(v, d.quote, lines=True))


def split_packed(df: DataFrame, keys: list[str], fields: dict[str, Grammar], at_least: int = 1) -> DataFrame:
    """(keys..., field_name, pos int, value string): every value of every listed field of `df`, each row once.

    pos counts from 1 over a text's non-empty values, repeats kept. Texts with fewer than `at_least` values are left out.
    Null, empty, blank-only texts and empty brackets have no value. Repeated rows (same keys and text) count once. Null
    keys are kept as they are. Other columns are ignored, whatever their names. Work per row is linear in its text's
    length; there is no limit on texts, values or dialect shapes (a large shape table is joined by shuffle).
    """
    ks = [f"_k{i}" for i in range(len(keys))]
    names = list(fields)
    texts = F.array(*[F.struct(F.lit(i).alias("field"), F.col(n).alias("text")) for i, n in enumerate(names)])
    own = df.select(*[F.col(k).alias(a) for k, a in zip(keys, ks)], F.inline(texts))
    by_field = lambda exprs: F.coalesce(*[F.when(F.col("field") == i, e) for i, e in enumerate(exprs)])
    if at_least > 1:
        marks = [r"[;|\n/&+,\"'\[\]{}()]" + (r"|(?i:\sand\s)" if g.persons else r"|\S[^\S\n]\S") for g in fields.values()]
        own = own.where(by_field([F.col("text").rlike(m) for m in marks]))
    else:
        own = own.where(F.regexp_replace("text", r"\s", "") != "")
    # One scan and one shuffle for all fields: repeated rows out, texts prepared and their shapes taken once, then written.
    prepared = own.dropDuplicates().withColumn("prepared", by_field([_prepared(F.col("text"), g) for g in fields.values()]))
    shaped, _ = written(prepared.select(*ks, "field", "prepared", _shape(F.col("prepared")).alias("shape")).withColumn("shape_id", F.md5("shape")), "shapes")
    parts = []
    for i, (name, grammar) in enumerate(fields.items()):
        mine = shaped.where(F.col("field") == i)
        model = dialect_model(mine.select("shape_id", "shape"), grammar)
        joined = mine.select(*ks, F.lit(name).alias("field_name"), "prepared", "shape_id").join(maybe_broadcast(model.select("shape_id", "dialect")), "shape_id")
        values = F.coalesce(*[F.when(F.col("dialect") == k, _values(F.col("prepared"), d)) for k, d in enumerate(grammar.dialects)])
        parts.append(joined.select(*ks, "field_name", values.alias("all_values")).where(F.size("all_values") >= at_least))
    rows = reduce(DataFrame.unionByName, parts).select(*ks, "field_name", F.posexplode("all_values").alias("pos0", "value"))
    return rows.select(*[F.col(a).alias(k) for k, a in zip(keys, ks)], "field_name", (F.col("pos0") + 1).cast("int").alias("pos"), "value")
