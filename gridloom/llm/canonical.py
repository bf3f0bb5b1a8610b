"""Mapping freely typed names to a canonical list.

Distinct values are normalised into query forms; a character n-gram inverted index over the list's forms gives
candidates; weighted (idf) cosine scores and ranks them; the best is accepted above a threshold and with a margin over
the best of another entry. An exact check vetoes candidates that differ by more than typing explains: the index cannot
tell two species of one genus with alike endings from one species misspelt. The rest is reported as unmatched.

Retrieval is exact: the list is indexed whole, in blocks that a task can hold, and every distinct value is scored
against every entry that shares an n-gram with it. Values are never shuffled by n-gram, so a frequent one is no hot key.
The index is a written table; tasks read it block by block, and the driver holds none of it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.textkeys import edits, folded, qgrams
from gridloom.storage import checkpointed, written

#: N-grams are hashed into so many slots: the weights fit into one array whatever the list's alphabet.
SLOTS = 1 << 16
THRESHOLD, MARGIN, MOST_EDITS = 0.3, 0.02, 3
#: The list is held by every task in blocks of about so many forms, one after the other.
BLOCK_FORMS = 200_000
#: Values that meet one block before the next is read.
BATCH = 50_000

#: Marks of doubt, which do not change the name that is meant.
DOUBT = {"cf", "aff", "nr", "near", "conf", "prope", "affin", "x", "cfr"}
#: Words in the place of an epithet that say that there is none.
NO_SPECIES = {"sp", "spp", "species", "ssp", "indet", "undet", "unknown", "gen", "nov", "voucher", "isolate", "specimen", "sample", "bold", "clone", "strain", "cultivar", "hybrid", "group", "complex", "n", "larva", "unidentified", "undetermined"}

_NAME = "value string, form string, kind string, genus string, epithet string"


def soft(word: str) -> str:
    """Folded further by what is confused in typing Latin names: y for i, rn for m."""
    return folded(word).replace("y", "i").replace("rn", "m")


def query_forms(text: str) -> list[tuple[str, str, str, str]]:
    """(form, kind, genus, epithet) of a typed name, none where it names no species.

    kind "F": the name in full, written together; "A": an abbreviated genus, by its first letter. Authors, years,
    subgenera, marks of doubt, voucher numbers and a repeated genus are left out; a name in the order "epithet, genus"
    gives a second form.
    """
    s = re.sub(r"\([^)]*\)|\[[^\]]*\]", " ", text.lower())
    swapped_mark = bool(re.match(r"^\s*[^\W\d_]+\s*,\s*[^\W\d_]+\s*$", s))
    s = re.sub(r"[_+/×]|(?<=\w)-(?=\w)", " ", s)
    words = [w for w in re.split(r"[^\w.']+", s) if w and re.search(r"[^\W\d_]", w)]
    words = [(w.strip(".'"), w.endswith(".")) for w in words]
    words = [w for w in words if w[0]]
    for i in range(len(words) - 1):
        if words[i][0] in ("sp", "spp") and words[i + 1][0] in DOUBT:
            del words[i]
            break
    words = [w for i, w in enumerate(words) if w[0] not in DOUBT or i == 0 and len(w[0]) == 1]
    if not words:
        return []
    while len(words) > 1 and len(words[0][0]) > 3 and edits(soft(words[0][0]), soft(words[1][0]), 1) <= 1:
        del words[0]
    first, dotted = words[0]
    if first in NO_SPECIES or re.match(r"^\d", first) and len(first) > 1 and sum(c.isdigit() for c in first) > 1:
        return []
    if len(words) == 1:
        # One word: only a name whose parts were run together can still be a species.
        return [(soft(first), "F", "", soft(first))] if len(first) >= 9 and not dotted else []
    second = words[1][0]
    if second in NO_SPECIES or len(second) < 3 or sum(c.isdigit() for c in second) > 1:
        return []
    if len(first) == 1 or dotted and len(first) <= 4:
        return [(soft(first[0] + second), "A", soft(first), soft(second))]
    forms = [(soft(first) + soft(second), "F", soft(first), soft(second))]
    if swapped_mark or len(words) == 2:
        forms.append((soft(second) + soft(first), "F", soft(second), soft(first)))
    return forms


def _slots(form: str, kind: str) -> dict[int, int]:
    return Counter(xxhash.xxh32_intdigest(kind + g) % SLOTS for g in qgrams(form, 3))


def _vector(form: str, kind: str, idf: np.ndarray) -> dict[int, float]:
    v = {k: (1 + math.log(n)) * float(idf[k]) for k, n in _slots(form, kind).items()}
    norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
    return {k: x / norm for k, x in v.items()}


def _meant(genus: str, epithet: str, kind: str, entry_genus: str, entry_epithet: str) -> int:
    """Edits between what was typed and an entry, MOST_EDITS + 1 if that is more than typing explains."""
    if kind == "A":
        abbreviated = entry_genus.startswith(genus[: max(1, len(genus))])
        # One letter of genus bears little: the epithet must be all but exact.
        d = edits(epithet, entry_epithet, 1) if abbreviated else MOST_EDITS + 1
        return d if d <= 1 else MOST_EDITS + 1
    if not genus:
        d = edits(epithet, entry_genus + entry_epithet, 2)
        return d if d <= 2 else MOST_EDITS + 1
    a = edits(genus, entry_genus, 2)
    if a > 2:
        return MOST_EDITS + 1
    b = edits(epithet, entry_epithet, 2)
    return a + b if b <= 2 and a + b <= MOST_EDITS else MOST_EDITS + 1


class GramIndex:
    """An inverted index over the forms of a block: for every slot the entries that have it, with their weights.

    `table`: columns id, kind, genus, epithet, slots (list of int) and weights (list of float) of every form.
    """

    def __init__(self, table):
        self.rows = list(zip(*(table[c].to_pylist() for c in ("id", "kind", "genus", "epithet"))))
        flat = lambda c: np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in table[c].chunks] or [np.empty(0)])
        sizes = np.concatenate([x.value_lengths().to_numpy(zero_copy_only=False) for x in table["slots"].chunks] or [np.empty(0, dtype=np.int64)]).astype(np.int64)
        slots = flat("slots").astype(np.int64)
        order = np.argsort(slots, kind="stable")
        self.owners = np.repeat(np.arange(len(sizes)), sizes)[order]
        self.weights = flat("weights").astype(np.float64)[order]
        self.starts = np.searchsorted(slots[order], np.arange(SLOTS + 1))

    def near(self, form: str, kind: str, idf: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """(entry, cosine) of every entry at or above the threshold."""
        owners, weights = [], []
        for k, x in _vector(form, kind, idf).items():
            part = slice(self.starts[k], self.starts[k + 1])
            owners.append(self.owners[part])
            weights.append(self.weights[part] * x)
        if not owners:
            return np.empty(0, dtype=np.int64), np.empty(0)
        owners, weights = np.concatenate(owners), np.concatenate(weights)
        if len(self.rows) <= 8 * len(owners):  # a dense sum is cheaper than sorting, unless few of many entries are met
            cosine = np.bincount(owners, weights, minlength=len(self.rows))
            hit = np.flatnonzero(cosine >= threshold)
            return hit, cosine[hit]
        who, of = np.unique(owners, return_inverse=True)
        cosine = np.bincount(of, weights, minlength=len(who))
        hit = np.flatnonzero(cosine >= threshold)
        return who[hit], cosine[hit]


def _read_block(path: str, block: int):
    import pyarrow.dataset as ds
    import pyarrow.fs as pafs

    fs, where = pafs.FileSystem.from_uri(path)
    return ds.dataset(where, filesystem=fs, format="parquet").to_table(columns=["id", "kind", "genus", "epithet", "slots", "weights"], filter=ds.field("block") == block)


def _matcher(path: str, blocks: int, idf, threshold: float, margin: float):
    """Candidates of each value in every block: the best that the check leaves and those within `margin` of it, which are all that can matter."""

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple[int, GramIndex | None] = (-1, None)

        def against(values: pd.DataFrame) -> pd.DataFrame:
            nonlocal held
            found = []
            for block in range(blocks):
                if held[0] != block:
                    held = (block, GramIndex(_read_block(path, block)))
                index = held[1]
                for r in values.itertuples(index=False):
                    hits, cosines = index.near(r.form, r.kind, idf.value, threshold)
                    floor = -1.0
                    for k in np.argsort(-cosines, kind="stable"):
                        n, cosine = hits[k], cosines[k]
                        if cosine < floor:
                            break
                        i, kind, genus, epithet = index.rows[n]
                        d = _meant(r.genus, r.epithet, r.kind, genus, epithet) if kind == r.kind else MOST_EDITS + 1
                        if d <= MOST_EDITS:
                            found.append((r.value, i, float(cosine), d))
                            floor = max(floor, cosine - margin - 1e-9)
            return pd.DataFrame(found, columns=["value", "id", "cosine", "edits"])

        waiting, n = [], 0
        for b in batches:  # many values meet a block before the next one is read
            waiting.append(b)
            n += len(b)
            if n >= BATCH:
                yield against(pd.concat(waiting))
                waiting, n = [], 0
        if waiting:
            yield against(pd.concat(waiting))

    return match


def match_names(values: DataFrame, value: str, entries: DataFrame, entry_id: str, entry_name: str, threshold: float = THRESHOLD, margin: float = MARGIN, block_forms: int = BLOCK_FORMS) -> DataFrame:
    """(value, entry_id, cosine, edits): for each distinct typed value the entry it means; unmatched values are absent.

    `entries`: one row per canonical "Genus epithet" name (other names are ignored, null and blank ones too; of rows
    with the same name the lowest id counts). Null and blank values match nothing. Of the candidates that the exact
    check leaves the one of the highest cosine is meant; if another entry's is within `margin`, none is. Either input may
    be empty. All values and all candidates above the threshold are weighed.
    """
    spark = values.sparkSession
    typed = values.select(F.col(value).alias("value")).where(F.regexp_replace(F.col(value), r"\s", "") != "").distinct()

    def forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(v, *f) for v in b["value"] for f in query_forms(v)]
            yield pd.DataFrame(rows, columns=["value", "form", "kind", "genus", "epithet"])

    def entry_forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, name in zip(b["id"], b["name"]):
                parts = name.lower().split()
                if len(parts) == 2:
                    g, e = soft(parts[0]), soft(parts[1])
                    rows += [(i, g + e, "F", g, e), (i, g[:1] + e, "A", g, e)]
            yield pd.DataFrame(rows, columns=["id", "form", "kind", "genus", "epithet"])

    listed = entries.where(F.regexp_replace(F.col(entry_name), r"\s", "") != "").groupBy(F.lower(F.trim(F.col(entry_name))).alias("name")).agg(F.min(entry_id).alias("id"))
    id_type = listed.schema["id"].dataType.simpleString()
    index = listed.mapInPandas(entry_forms, f"id {id_type}, form string, kind string, genus string, epithet string")
    queries = typed.repartition(spark.sparkContext.defaultParallelism).mapInPandas(forms, _NAME)

    def slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k,) for f, kind in zip(b["form"], b["kind"]) for k in _slots(f, kind)]
            yield pd.DataFrame(rows, columns=["slot"])

    # Document frequencies: at most SLOTS rows, whatever the list.
    frequency = {r.slot: r.n for r in index.mapInPandas(slots, "slot int").groupBy("slot").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_forms = max(1, index.count())
    weights = np.full(SLOTS, math.log(1 + n_forms), dtype="float32")
    for slot, n in frequency.items():
        weights[slot] = math.log(1 + n_forms / n)
    idf = spark.sparkContext.broadcast(weights)

    blocks = math.ceil(n_forms / block_forms)

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            each = [_vector(f, k, idf.value) for f, k in zip(b["form"], b["kind"])]
            yield b[["id", "kind", "genus", "epithet", "block"]].assign(slots=[list(v) for v in each], weights=[list(v.values()) for v in each])

    numbered = index.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).repartition(blocks, "block")
    _, path = written(numbered.mapInPandas(vectors, f"id {id_type}, kind string, genus string, epithet string, block int, slots array<int>, weights array<double>"), "gram-index")
    scored = checkpointed(queries.mapInPandas(_matcher(path, blocks, idf, threshold, margin), f"value string, id {id_type}, cosine double, edits int"))
    one = scored.groupBy("value", "id").agg(F.max(F.struct("cosine", (-F.col("edits")).alias("minus"))).alias("m")).select("value", "id", F.col("m.cosine").alias("cosine"), (-F.col("m.minus")).alias("edits"))
    # Each value's best two, combined before they are sent: the best, and the next for the margin.
    best = one.groupBy("value").agg(F.max(F.struct("cosine", (-F.col("edits")).alias("minus"), "id")).alias("m"))
    rivals = one.join(best, "value").where(F.col("id") != F.col("m.id")).groupBy("value").agg(F.max("cosine").alias("next_cosine"))
    clear = F.col("next_cosine").isNull() | (F.col("m.cosine") - F.col("next_cosine") >= margin)
    return best.join(rivals, "value", "left").where(clear).select(F.col("value").alias(value), F.col("m.id").alias(entry_id), F.col("m.cosine").alias("cosine"), (-F.col("m.minus")).alias("edits"))
