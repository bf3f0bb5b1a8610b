"""Variant spellings of names typed by people: persons and institutions.

Spellings are parsed into forms (surname, given name or initials; or town, kind of institution, subject). MinHash
banding over the padded q-grams of the surname or town proposes pairs; the number of bands follows from the collision
curve and a wanted recall. The letters of a q-gram are put in order, so that two swapped letters change two q-grams, not
three. Pairs are verified by Monge-Elkan similarity over the parsed tokens, with what abbreviation, reordering, nicknames
and a slip of typing may change; nicknames are learned from spellings that give both names. Verified links are
clustered into stars around the most complete forms, so that a bare "W. Smith" does not tie two Smiths together.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm.textkeys import edits, folded, jaro_winkler, monge_elkan, qgrams, unaccented
from gridloom.operators.skew import maybe_broadcast, salted_join
from gridloom.storage import checkpointed

ROWS_PER_BAND, FLOOR, RECALL = 3, 0.42, 0.99
#: Forms are linked at this Monge-Elkan similarity: above it no token of two or three may be without its partner.
THRESHOLD = 0.8
#: Surnames with which a nickname and the name it stands for must be written together.
NICK_SUPPORT = 2

#: Titles before a name.
TITLES = {"dr", "prof", "professor", "mr", "mrs", "ms", "miss", "sir", "mag", "ing"}

#: Kinds of institution, in full; what is typed may be a part of them or one slip away.
KINDS = ("museum", "garden", "centre", "university", "laboratory", "institute", "department", "school", "college", "academy", "herbarium", "station", "society", "faculty", "foundation", "collection", "survey", "office", "agency")
#: Short forms of these that are not their beginnings, and other spellings.
KIND_ALIASES = {"gdn": "garden", "gdns": "garden", "ctr": "centre", "center": "centre", "cntr": "centre", "dept": "department", "dpt": "department", "univ": "university", "uni": "university", "lab": "laboratory", "labs": "laboratory", "inst": "institute", "mus": "museum", "coll": "collection", "herb": "herbarium", "museo": "museum", "instituto": "institute", "universidad": "university"}
_SMALL = {"of", "the", "at", "for", "and", "de", "in"}


def _letters(word: str) -> str:
    return "".join(c for c in folded(word) if c.isalpha())


def _initials(word: str, others_lower: bool) -> str:
    """The initials a word consists of ("J.L.", "JL", "J"), or ""."""
    w = unaccented(word)
    if re.fullmatch(r"(?:[A-Za-z]\.){1,4}-?[A-Za-z]?\.?", w) or re.fullmatch(r"[A-Za-z]\.?", w):
        return "".join(c for c in w.lower() if c.isalpha())
    if others_lower and re.fullmatch(r"[A-Z]{2,3}", w):
        return w.lower()
    return ""


def parse_person(spelling: str) -> dict:
    """surname, given, initials ("" where unknown), nick, and for two plain words: swap_to, the reading the other way round."""
    s = re.sub(r"\s+", " ", spelling).strip().strip('"')
    nick = re.search(r"[\"“(']([^\"”()']{2,})[\"”)']", s)
    if nick:
        s = (s[: nick.start()] + " " + s[nick.end() :]).strip()
    words = [w for w in s.replace(",", " , ").split() if w.strip(".").lower() not in TITLES or w == ","]
    nick_word = _letters(nick.group(1)) if nick else ""
    titled = len(words) < len(s.replace(",", " , ").split())
    if "," in words:
        k = words.index(",")
        left, right = words[:k], [w for w in words[k + 1 :] if w != ","]
        if left and right:
            ini = [_initials(w, True) for w in right]
            given = next((_letters(w) for w, i in zip(right, ini) if not i), "")
            marks = "".join(i or _letters(w)[:1] for w, i in zip(right, ini))
            return {"core": "".join(map(_letters, left)), "given": given, "initials": marks, "nick": nick_word, "sure": True, "swap": ""}
        words = left + right
    if not words:
        return {"core": "", "given": "", "initials": "", "nick": nick_word, "sure": True, "swap": ""}
    lower = any(re.search(r"[a-zß-ÿ]", w) and len(w) > 2 for w in words)
    ini = [_initials(w, lower) for w in words]
    full = [i for i, x in enumerate(ini) if not x]
    if not full:
        return {"core": "".join(ini), "given": "", "initials": "", "nick": nick_word, "sure": True, "swap": ""}
    if len(full) == 1:
        return {"core": _letters(words[full[0]]), "given": "", "initials": "".join(ini), "nick": nick_word, "sure": True, "swap": ""}
    caps = [i for i in full if re.fullmatch(r"[^\Wa-z\d_]{3,}", unaccented(words[i]))]
    if len(caps) == 1 and len(full) == 2:
        other = full[1] if caps[0] == full[0] else full[0]
        marks = _letters(words[other])[:1] + "".join(x for x in ini if x)
        return {"core": _letters(words[caps[0]]), "given": _letters(words[other]), "initials": marks, "nick": nick_word, "sure": True, "swap": ""}
    first, last = full[0], full[-1]
    middle = "".join(ini[i] or _letters(words[i])[:1] for i in range(first + 1, last))
    given, core = _letters(words[first]), _letters(words[last])
    sure = bool(middle) or bool(nick_word) or titled
    return {"core": core, "given": given, "initials": given[:1] + middle, "nick": nick_word, "sure": sure, "swap": "" if sure else core}


def _kind_of(word: str) -> str:
    w = _letters(word)
    if w in KIND_ALIASES:
        return KIND_ALIASES[w]
    if len(w) >= 3:
        for k in KINDS:
            if w == k or (word.endswith(".") and k.startswith(w)) or len(w) >= 5 and edits(w, k, 2) <= (1 if len(k) < 8 else 2):
                return k
    return ""


def parse_institution(spelling: str) -> dict:
    """core: the town; given: kind and subject words in order ("museum marine biology"); initials: the letters of these."""
    s = re.sub(r"\([^)]*\)", " ", spelling)
    s = re.sub(r"\s+-\s+|,|;|\bat\b", " , ", s)
    s = re.sub(r"(?<=[A-Z]{2})-(?=\w)", " , ", s)
    parts = [[w for w in p.split() if w.strip(".").lower() not in ("the",)] for p in s.split(",")]
    parts = [p for p in parts if p]
    if not parts:
        return {"core": "", "given": "", "initials": ""}
    lower = bool(re.search(r"[a-z]", spelling))
    acronym = lambda w: lower and bool(re.fullmatch(r"[A-Z]{2,6}", w))
    kinds = [[_kind_of(w) for w in p] for p in parts]
    org = next((i for i, k in enumerate(kinds) if any(k)), None)
    if org is None:
        flat = [w for p in parts for w in p]
        short = [w for w in flat if acronym(w)]
        if short:
            return {"core": "".join(_letters(w) for w in flat if w is not short[0]), "given": "", "initials": short[0].lower()}
        town = parts[-1] if len(parts) > 1 else flat[-1:]
        rest = [w for p in parts[:-1] for w in p] if len(parts) > 1 else flat[:-1]
        return _institution("", rest, town)
    words, found = parts[org], kinds[org]
    k = next(i for i, x in enumerate(found) if x)
    town = [w for i, p in enumerate(parts) if i != org for w in p if not acronym(w)]
    subject = [w for i, w in enumerate(words) if i != k]
    if not town and len(words) > 2:
        of = [w.lower() for w in words].index("of") if "of" in [w.lower() for w in words] else None
        if k > 0 and of is not None and of > k:
            town, subject = words[:k], words[k + 1 :]
        else:
            last = len(words) - 1
            town, subject = words[last:], [w for i, w in enumerate(words) if i not in (k, last)]
    return _institution(found[k], subject, town)


def _institution(kind: str, subject: list[str], town: list[str]) -> dict:
    words = [w for w in subject if w.lower() not in _SMALL and _letters(w)]
    marked = [_letters(w) + ("." if w.endswith(".") else "") for w in words]
    return {"core": "".join(map(_letters, town)), "given": " ".join([kind, *marked]).strip(), "initials": kind[:1] + "".join(_letters(w)[0] for w in words)}


def _close(a: str, b: str) -> bool:
    """The same word but for one slip of typing (two in a long word), or m for rn."""
    if a == b:
        return True
    short = min(len(a), len(b))
    if short < 4:
        return short == 3 and a[0] == b[0] and abs(len(a) - len(b)) == 1 and edits(a, b, 1) <= 1
    most = 1 if short < 9 else 2
    return edits(a, b, most) <= most or ("rn" in a or "rn" in b) and edits(a.replace("rn", "m"), b.replace("rn", "m"), most) <= most


def _given_alike(a: str, b: str) -> float:
    if len(a) <= 1 or len(b) <= 1:
        return 1.0 if a[:1] == b[:1] else 0.0
    return jaro_winkler(a, b) if _close(a, b) else 0.0


def _given_names(p: dict) -> list[str]:
    """The given name or first initial, the nickname, and the names these may stand for."""
    return [x for x in [p["given"] or p["initials"][:1], p["nick"], *(p["means"] or "").split()] if x]


def same_person(a: dict, b: dict) -> float:
    """Monge-Elkan similarity of two parsed persons over surname, given name and, where both have one, middle initial.

    Tokens meet tokens of their kind only; words more than a slip apart have no similarity; a person without any
    given name is like nobody.
    """
    mine, other = _given_names(a), _given_names(b)
    if not a["core"] or not b["core"] or not mine or not other:
        return 0.0
    given = max(_given_alike(x, y) for x in mine for y in other)
    x, y = a["initials"][1:2], b["initials"][1:2]
    both = bool(x and y)
    tokens = lambda p: ["s" + p["core"], "g", *(["m" + p["initials"][1:2]] if both else [])]

    def alike(u: str, v: str) -> float:
        if u[0] != v[0]:
            return 0.0
        if u[0] == "g":
            return given
        if u[0] == "m":
            return float(u == v)
        return jaro_winkler(u[1:], v[1:]) if _close(u[1:], v[1:]) else 0.0

    return monge_elkan(tokens(a), tokens(b), alike)


def _subject_alike(u: str, v: str) -> float:
    x, y = u.rstrip("."), v.rstrip(".")
    if x == y or u.endswith(".") and y.startswith(x) or v.endswith(".") and x.startswith(y):
        return 1.0
    return jaro_winkler(x, y) if _close(x, y) else 0.0


def same_institution(a: dict, b: dict) -> float:
    """Monge-Elkan similarity of two parsed institutions over town, kind and subject, or town and acronym."""
    if not a["core"] or not b["core"]:
        return 0.0
    acronym = not a["given"] or not b["given"]
    u, v = a["given"].split(), b["given"].split()
    if acronym:
        mine, other = ["a" + a["initials"]], ["a" + b["initials"]]
    else:
        mine, other = ["k" + u[0], *(["w"] if u[1:] or v[1:] else [])], ["k" + v[0], *(["w"] if u[1:] or v[1:] else [])]

    def subject() -> float:
        """The subject's words by Monge-Elkan; words that were run together, by their letters."""
        joined, rest = "".join(u[1:]).replace(".", ""), "".join(v[1:]).replace(".", "")
        words = monge_elkan(u[1:], v[1:], _subject_alike) if len(u) == len(v) else 0.0
        return max(words if words >= 0.9 else 0.0, 0.9 if joined and rest and edits(joined, rest, 2) <= 2 else 0.0)

    def alike(x: str, y: str) -> float:
        if x[0] != y[0]:
            return 0.0
        if x[0] == "w":
            return subject()
        if x[0] in "ak":
            return float(x == y and len(x) > 1)
        return jaro_winkler(x[1:], y[1:]) if _close(x[1:], y[1:]) else 0.0

    return monge_elkan(["t" + a["core"], *mine], ["t" + b["core"], *other], alike)


def bands_needed(similarity: float, recall: float, rows: int) -> int:
    """The least number of bands of `rows` MinHashes with which a pair of this Jaccard similarity collides with probability `recall`."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def band_grams(core: str) -> set[str]:
    """The padded 2-grams of a word, the letters of each in alphabetical order, with m for rn."""
    return {"".join(sorted(g)) for g in qgrams(core.replace("rn", "m"), 2)}


def _band_hashes(bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return rng.integers(1, 1 << 62, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 62, bands * rows, dtype=np.uint64)


def _band_keys(core: str, bands: int, rows: int, a: np.ndarray, b: np.ndarray) -> list[int]:
    grams = np.array(sorted({xxhash.xxh32_intdigest(g) for g in band_grams(core)}), dtype=np.uint64)
    mixed = (grams[:, None] * a[None, :] + b[None, :]) >> np.uint64(32)  # multiply-shift hashing
    signature = mixed.min(axis=0).astype(np.uint64).reshape(bands, rows)
    return [xxhash.xxh64_intdigest(signature[k].tobytes(), seed=k) - (1 << 63) for k in range(bands)]


_FORM = "field_name string, core string, given string, initials string, nick string, means string"
_PARSED = "field_name string, core string, given string, initials string, nick string"


def name_forms(names: DataFrame) -> DataFrame:
    """(name_id, field_name, core, given, initials, nick, means) of every spelling.

    Two plain words are read the other way round if, in spellings that leave no doubt, the first stands as a surname and
    the second as a given name more often than the reverse. means: the given names, separated by blanks, that a given
    name or nickname may stand for, learned from spellings that write both (`William "Bill" Smith`).
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, f, s in zip(b["name_id"], b["field_name"], b["spelling"]):
                p = parse_person(s) if f == "collectors" else parse_institution(s) | {"nick": "", "sure": True, "swap": ""}
                rows.append((i, f, p["core"], p["given"], p["initials"], p["nick"], p["sure"], p["swap"]))
            yield pd.DataFrame(rows, columns=["name_id", "field_name", "core", "given", "initials", "nick", "sure", "swap"])

    parsed = names.select("name_id", "field_name", "spelling").dropna().mapInPandas(parse, f"name_id long, {_PARSED}, sure boolean, swap string")
    parsed = checkpointed(parsed.where(F.col("core") != ""))
    sure = parsed.where(F.col("sure") & (F.col("field_name") == "collectors") & (F.length("given") > 1))
    uses = sure.select(F.col("given").alias("word"), F.col("core").alias("with"), F.lit(1).alias("use")).union(sure.select("core", "given", F.lit(-1))).distinct()
    uses = uses.groupBy("word").agg(F.sum("use").alias("lean"))  # more surnames after it than given names before it
    asked = parsed.where(F.col("swap") != "")
    words = maybe_broadcast(uses)
    asked = asked.join(words.select(F.col("word").alias("given"), F.col("lean").alias("first")), "given", "left").join(words.select(F.col("word").alias("core"), F.col("lean").alias("last")), "core", "left")
    turned = F.coalesce("last", F.lit(0)) > F.coalesce("first", F.lit(0))
    asked = asked.select("name_id", "field_name", F.when(turned, F.col("given")).otherwise(F.col("core")).alias("core"), F.when(turned, F.col("core")).otherwise(F.col("given")).alias("given"), "nick").withColumn("initials", F.substring("given", 1, 1))
    columns = ["name_id", "field_name", "core", "given", "initials", "nick"]
    forms = checkpointed(parsed.where(F.col("swap") == "").select(columns).unionByName(asked.select(columns)))
    written_both = forms.where((F.col("nick") != "") & (F.length("given") > 1)).groupBy("nick", "given").agg(F.countDistinct("core").alias("n")).where(F.col("n") >= NICK_SUPPORT)
    stands_for = maybe_broadcast(written_both.groupBy(F.col("nick").alias("short")).agg(F.array_join(F.array_sort(F.collect_set("given")), " ").alias("names")))  # a vocabulary of names
    out = forms.join(stands_for.select(F.col("short").alias("given"), F.col("names").alias("m1")), "given", "left").join(stands_for.select(F.col("short").alias("nick"), F.col("names").alias("m2")), "nick", "left")
    return out.select(*columns, F.concat_ws(" ", "m1", "m2").alias("means"))


def link_forms(forms: DataFrame, floor: float = FLOOR, recall: float = RECALL, rows: int = ROWS_PER_BAND, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, similarity): the links between distinct forms (form ids of `forms`: form_id and the parsed columns)."""
    bands = bands_needed(floor, recall, rows)
    a, b = _band_hashes(bands, rows)

    def letters(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Block letter of a form: the given name's first letter, also of the names a nickname may stand for."""
        for x in batches:
            out = []
            for r in x.itertuples(index=False):
                marks = {""}
                if r.field_name == "collectors":
                    marks = {m[:1] for m in _given_names(r._asdict())} | ({r.initials[:1]} if r.initials else set())
                out += [(r.form_id, r.field_name, m, r.core) for m in marks]
            yield pd.DataFrame(out, columns=["form_id", "field_name", "letter", "core"])

    blocked = checkpointed(forms.select("form_id", *[c.split()[0] for c in _FORM.split(", ")]).mapInPandas(letters, "form_id long, field_name string, letter string, core string"))
    cores = blocked.select("field_name", "letter", "core").distinct()

    def bucket(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for start in range(0, len(x), 500):  # some hundred bands a row: a few rows at a time
                out = [(r.field_name, r.letter, r.core, k) for r in x.iloc[start : start + 500].itertuples(index=False) for k in _band_keys(r.core, bands, rows, a, b)]
                yield pd.DataFrame(out, columns=["field_name", "letter", "core", "band"])

    keys = ["field_name", "letter"]
    # Spread by hand, as the rows are few and the bands many; written, as the join reads them three times.
    spread = cores.repartition(cores.sparkSession.sparkContext.defaultParallelism, "letter", "core")
    buckets = checkpointed(spread.mapInPandas(bucket, "field_name string, letter string, core string, band long"))
    other = buckets.withColumnRenamed("core", "other")
    pairs = salted_join(buckets, other, [*keys, "band"]).where((F.col("core") < F.col("other")) & (F.abs(F.length("core") - F.length("other")) <= 3)).select(*keys, "core", "other").distinct()

    def close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield x[[_close(u, v) for u, v in zip(x["core"], x["other"])]]

    near = pairs.mapInPandas(close, "field_name string, letter string, core string, other string").unionByName(cores.select(*keys, "core", F.col("core").alias("other")))
    left = near.join(blocked.withColumnRenamed("form_id", "a"), [*keys, "core"])
    candidates = salted_join(left, blocked.select("field_name", "letter", F.col("core").alias("other"), F.col("form_id").alias("b")), [*keys, "other"])
    candidates = candidates.where(F.col("a") != F.col("b")).select("field_name", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    parsed = F.struct(*[c.split()[0] for c in _FORM.split(", ")])
    full = candidates.join(forms.select(F.col("form_id").alias("a"), parsed.alias("x")), "a").join(forms.select(F.col("form_id").alias("b"), parsed.alias("y")), "b")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for z in batches:
            sims = [(same_person if f == "collectors" else same_institution)(p, q) for f, p, q in zip(z["field_name"], z["x"], z["y"])]
            out = z[["a", "b"]].assign(similarity=sims)
            yield out[out["similarity"] >= threshold]

    return full.select("field_name", "a", "b", "x", "y").mapInPandas(verify, "a long, b long, similarity double")


def stars(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(form_id, star): star clustering of `nodes` (form_id, rank: higher is a better centre) along `links` (a, b, similarity).

    In rounds, every free node with no better free neighbour becomes a centre, and its free neighbours join the best
    centre they touch (similarity, then rank, then lowest id). Nodes without links are stars of their own. The rounds
    end when none is free; each round frees at least the best free node of every component.
    """
    both = links.select("a", "b", "similarity").union(links.select(F.col("b"), F.col("a"), F.col("similarity")))
    degree = both.groupBy("a").agg(F.count(F.lit(1)).alias("degree"))
    order = F.struct("rank", F.coalesce("degree", F.lit(0)).alias("degree"), (-F.col("form_id")).alias("minus")).alias("ord")
    free = checkpointed(nodes.join(degree.withColumnRenamed("a", "form_id"), "form_id", "left").select("form_id", order))
    both = checkpointed(both)
    done = None
    while True:
        edges = both.join(free.select(F.col("form_id").alias("a"), F.col("ord").alias("ord_a")), "a").join(free.select(F.col("form_id").alias("b"), F.col("ord").alias("ord_b")), "b")
        best = edges.groupBy("a").agg(F.max("ord_b").alias("best"))
        state = checkpointed(free.join(best.withColumnRenamed("a", "form_id"), "form_id", "left"))
        centres = state.where(F.col("best").isNull() | (F.col("ord") > F.col("best"))).select("form_id")
        touched = edges.join(centres.select(F.col("form_id").alias("b")), "b").groupBy("a").agg(F.max(F.struct(F.round("similarity", 9).alias("s"), "ord_b", "b")).alias("m")).select(F.col("a").alias("form_id"), F.col("m.b").alias("star"))
        assigned = checkpointed(touched.join(centres, "form_id", "left_anti").unionByName(centres.withColumn("star", F.col("form_id"))))
        done = assigned if done is None else done.unionByName(assigned)
        free = checkpointed(free.join(assigned, "form_id", "left_anti"))
        if free.isEmpty():
            return done


def same_names(names: DataFrame) -> DataFrame:
    """(name_id, field_name, star): the entity of every spelling of `names` (name_id long, field_name, spelling).

    field_name "collectors" is read as a person, any other as an institution. Rows with a null id, field or spelling, or
    no letter in it, are left out (they mean nobody). Repeated rows count once. Only spellings of one field_name are tied.
    """
    forms = checkpointed(name_forms(names).dropDuplicates(["name_id"]))
    columns = ["field_name", "core", "given", "initials", "nick", "means"]
    distinct = checkpointed(forms.groupBy(*columns).agg(F.min("name_id").alias("form_id")))
    links = checkpointed(link_forms(distinct))
    # Complete forms make centres: a full given name, then more initials, then more links.
    complete = F.when(F.length("given") > 1, 2).otherwise(0) + F.least(F.length("initials"), F.lit(2))
    member = stars(distinct.select("form_id", complete.cast("int").alias("rank")), links)
    return forms.join(distinct, columns).join(member, "form_id").select("name_id", "field_name", "star")


def name_pairs(members: DataFrame) -> DataFrame:
    """(name_id_a, name_id_b): all pairs of spellings of one entity, the lower id first, each once."""
    a = members.select("field_name", "star", F.col("name_id").alias("name_id_a"))
    b = members.select("field_name", "star", F.col("name_id").alias("name_id_b"))
    return salted_join(a, b, ["field_name", "star"]).where(F.col("name_id_a") < F.col("name_id_b")).select("name_id_a", "name_id_b")
