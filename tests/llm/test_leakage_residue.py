import random

import numpy as np

from gridloom.llm import leakage, residue

VOCAB = [f"{a}{b}{c}" for a in "bcdfgl" for b in "aeio" for c in ("run", "min", "sot", "kel", "vad")]


def _text(rnd, n):
    return " ".join(rnd.choice(VOCAB) for _ in range(n))


def test_blocks_find_all_within_the_radius():
    rng = np.random.default_rng(3)
    prints = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    queries = prints[rng.integers(0, 300, 2000)].copy()
    for k in range(len(queries)):
        for bit in rng.choice(64, rng.integers(0, 7), replace=False):
            queries[k] ^= np.uint64(1) << np.uint64(bit)
    index = leakage.BlockIndex(prints, np.arange(300), 3)
    at, found = index.near(queries)
    got = set(zip(at.tolist(), index.owners[found].tolist()))
    want = {(q, o) for q in range(len(queries)) for o in range(300) if bin(int(queries[q] ^ prints[o])).count("1") <= 3}
    assert got == want


def test_simhash_windows_are_the_windows_own():
    h = leakage.word_hashes("one two three four five six seven eight nine ten".split())
    each = leakage.simhashes(h, 8)
    assert len(each) == 3
    assert all(each[k] == leakage.simhashes(h[k : k + 8], 8)[0] for k in range(3))
    assert len(leakage.simhashes(h[:3], 8)) == 1 and len(leakage.simhashes(h[:0], 8)) == 0


def test_simhash_of_three_words_is_the_sign_of_their_sum():
    h = leakage.word_hashes("one two three four five six".split())
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).astype(int) * 2 - 1
    want = [np.packbits(bits[k : k + 3].sum(axis=0) > 0).view(np.uint64)[0] for k in range(4)]
    assert leakage.simhashes(h, 3).tolist() == want


def _leaked(doc, item):
    block = leakage._Items([(1, " ".join(item))], leakage.SHARE, leakage.WIDTH, leakage.RADIUS)
    for _, n, places in block.candidates(leakage.word_hashes(doc), np.zeros(len(doc), dtype=int)):
        share, similarity = leakage.held(doc, item, block.weights[n], places, block.at[n])
        assert (share, similarity) == leakage.held(doc, item, block.weights[n])
        return share >= leakage.SHARE - leakage.SLACK and similarity >= leakage.LEAST_SIMILARITY
    return False


def test_recall_with_words_changed_at_regular_distances():
    rnd = random.Random(4)
    for every in (4, 5, 6, 7, 8):
        found = 0
        for t in range(100):
            item = _text(rnd, 60).split()
            start = rnd.randrange(21)
            piece = [w if (k + t) % every else f"zz{t}q{k}" for k, w in enumerate(item[start : start + 40])]
            found += _leaked([f"f{k}" for k in range(50)] + piece + [f"g{k}" for k in range(50)], item)
        assert found >= 90, (every, found)


def test_quotes_that_overlap_two_passages_do_not_hide_them():
    item = [f"w{k}" for k in range(100)]
    two = item[10:27] + ["x"] * 20 + item[40:57]
    assert leakage.held(two, item)[0] == 0.34
    assert leakage.held(two + (["y"] * 20 + item[20:38] + ["z"] * 20 + item[38:50]) * 9, item)[0] >= 0.34
    assert _leaked((["y"] * 20 + item[17:35]) * 9 + ["z"] * 20 + two, item)


def test_best_pair_of_passages_against_all_pairs():
    rnd = random.Random(9)
    for _ in range(60):
        item = [f"w{k}" for k in range(rnd.randint(8, 40))]
        doc = []
        for _ in range(rnd.randint(1, 8)):
            a = rnd.randrange(len(item))
            doc += item[a : a + rnd.randint(3, 12)] + [f"x{rnd.random()}"] * 10
        spans = leakage.passages(doc, item)
        sizes = [x[3] - x[2] for x in spans]
        sizes += [x[3] - x[2] + y[3] - y[2] for x in spans for y in spans if x[1] <= y[0] and (x[3] <= y[2] or y[3] <= x[2])]
        assert leakage.held(doc, item)[0] == max(sizes, default=0) / len(item)


def test_long_tags_are_no_words():
    assert leakage.words_of(f"one <a href='{'u ' * 300}'>two</a> 3 < 4 &amp; five") == ["one", "two", "3", "4", "five"]


def test_leaks_against_brute_force(spark):
    rnd = random.Random(11)
    items = {i: _text(rnd, rnd.randint(60, 150)) for i in range(12)}
    docs, want = [], set()
    for d in range(160):
        body, kind = _text(rnd, rnd.randint(20, 200)), d % 5
        i = rnd.randrange(12)
        w = items[i].split()
        if kind == 0:  # whole, touched up
            piece = [x if rnd.random() > 0.05 else "zzz" for x in w]
            body, held = f"{body} <p>{', '.join(piece).upper()}</p> {body}", True
        elif kind == 1:  # two passages of a quarter each
            n = len(w) // 4 + 1
            body, held = f"{' '.join(w[:n])}. {body}! {' '.join(w[-n:])}", True
        elif kind == 2:  # a borrowed phrase
            body, held = f"{body} {' '.join(w[5:11])} {body}", False
        elif kind == 3:  # one passage well below the share
            body, held = f"{body} {' '.join(w[: len(w) // 6])} {body}", False
        else:
            held = False
        if held:
            want.add((d, i))
        docs.append((d, body, "x"))
    docs += docs[:7] + [(900, None, "x"), (901, "", "x"), (902, _text(rnd, 150_000) + " " + items[3], "x")]
    want.add((902, 3))
    df = spark.createDataFrame(docs, "doc_id long, text string, share string")
    it = spark.createDataFrame([*items.items(), (50, None), (51, ""), (52, "  ... ")], "item_id long, text string")
    for block in (300, 1_000_000):
        got = leakage.leaks(df, it, block_words=block).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    assert leakage.leaks(df.limit(0), it).count() == 0 and leakage.leaks(df, it.limit(0)).count() == 0


def test_short_items(spark):
    df = spark.createDataFrame([(1, "say Hello, big world now"), (2, "hello small world")], "doc_id long, text string")
    it = spark.createDataFrame([(1, "hello big world")], "item_id long, text string")
    # An item shorter than a window is one window; a document that is no longer than it can equal it.
    assert {r.doc_id for r in leakage.leaks(df.union(spark.createDataFrame([(3, "HELLO big... world")], df.schema)), it).collect()} >= {3}


CASES = {
    "slot": ["Dear {{name}}, welcome", "Total: ${n_records} of it", "Loc. %(locality)s m", "at %%TITLE%% now", "see #COUNTRY# map", "in [[DATE]] it", "the [INSERT TITLE] was", "by [your name] of", "x <DATE HERE> y", "x <<site_name>> y", "a <?= $date ?> b", "a {% title %} b", "a @@date@@ b", "a __DATE__ b", "a XXDATEXX b", "TODO: add title", "of them in {0}", "text [habitat goes here] text"],
    "printed": ["Collected at undefined by undefined on NaN-NaN-NaN, undefined m.", "Specimen null from null, null records in cell NaN_NaN.", "[object Object] is known", "None found in None on Invalid Date; depth None"],
    "message": ["404 Not Found. The requested map tile could not be opened on this server.\nHome | Search | Help", "Aa bb - Town\nAccess denied. You do not have permission to view lot 1.", "<html><body>HTTP status 500\nSomething went wrong while we loaded this bin. Try again in 2 minutes.</body></html>", "ERREUR 400 : SERVICE INDISPONIBLE. VEUILLEZ RÉESSAYER DANS 2 MINUTES.", "Please enable JavaScript in your browser to view this page.", "noscript: the gallery needs client-side scripting; switch it on and refresh.", 'Traceback (most recent call last):\n  File "a.py", line 3, in b\nKeyError: \'x\'', "Lorem ipsum dolor sit amet. Lorem ipsum dolor sit amet.", "texte de remplissage Texte de remplissage", "BOLD:ZAA1\nYour session has expired. Sign in again to continue.", "blah " * 30_000],
    None: ["Access to the reserve was denied in 1947, so the trap stayed.", "The client met 404 Not Found for 5 families, so the team queued them again.", "Set N = {1, 20, 2654} counts the plots; f(x) = {x : x > 3} holds.", "The word undefined in column 15 means that she left it blank.", "Sheet #731# and tag <42> are stamped marks, and %5 stands for cover.", "Label reads \"[date torn] Town\" [sic] [illegible].", "Null results are useful: none of 97 traps held it.", "Filler words in the diary were left out, apart from 3 lines.", "The museum page was down for maintenance in March, which delayed 7 loans.", "Home | Search | Help", "", "   ", "Aa bb - Town", "A server error stopped the client at row 4; after a restart we kept the sheet.", "y" * 200_000],
}


def test_residue_cases(spark):
    rows = [(n, t, "web", k) for n, (k, t) in enumerate((k, t) for k, v in CASES.items() for t in v)]
    df = spark.createDataFrame([(i, t, s, 1) for i, t, s, _ in rows] + [(999, None, "web", 1), (998, "Dear {{name}}", None, 1), (0, rows[0][1], "web", 1)], "doc_id long, text string, source string, kind int")
    got = {r.doc_id: r.kind for r in residue.residue(df).collect()}
    want = {i: k for i, _, _, k in rows if k} | {998: "slot"}
    assert got == want, {i: (rows[i][1][:60] if i < len(rows) else i, got.get(i), want.get(i)) for i in set(got) ^ set(want) | {i for i in got if got[i] != want.get(i)}}
    assert residue.residue(df.limit(0)).count() == 0


def test_recurrent_lines_are_subtracted(spark):
    error = "Something went wrong while we loaded this page."
    own = [(k, f"Our own menu line here\n{error}", "a") for k in range(8)] + [(100, f"A line of its own here\n{error}", "a")] + [(200 + k, "Our own menu line here", "a") for k in range(3)]
    got = {r.doc_id for r in residue.residue(spark.createDataFrame(own, "doc_id long, text string, source string")).collect()}
    assert got == set(range(8))


OTHER_WORDS = ["We could not load this record. Come back later.", "Ein interner Serverfehler ist aufgetreten.", "Una excepción ocurrió en el servidor", "502", "Name: <insert name>", "Dear :first_name, see [SPECIES NAME].", "Dear {first_name}, welcome", f"Kept in [INSERT {'a b ' * 40}] until May", "O servidor não está disponível no momento.", "Le serveur a rencontré une erreur.", "La page demandée n'existe pas."]
OWN_WORDS = ["The set {ab, cd} is closed; ratio 4:6 of leaves.", "We could not reach the ridge, so the traps stayed out.", "An error of 3 mm was found in the wing of a beetle kept in the museum at Town. It is small.", "The browser deer ate the young birch.", "Nicht alle Blätter wurden gefunden.", "Page 404 of the diary lists 12 birds.", "a [sic] b [illegible] c (:) d"]


def test_messages_and_slots_in_words_of_no_list(spark):
    rows = [(k, t, "w") for k, t in enumerate(OTHER_WORDS)] + [(100 + k, t, "w") for k, t in enumerate(OWN_WORDS)]
    got = {r.doc_id for r in residue.residue(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == set(range(len(OTHER_WORDS))), ([OTHER_WORDS[k] for k in range(len(OTHER_WORDS)) if k not in got], [OWN_WORDS[k - 100] for k in got if k >= 100])


def test_long_recurrent_lines_and_learned_companions(spark):
    line = "this is the line that our site puts under every page of the whole collection"
    rows = [(k, f"{line}\nError: something went wrong.", "a") for k in range(10)]
    rows += [(20 + k, f"Not found: this page does not exist. Have a beetle of the month {k} instead.", "b") for k in range(6)]
    rows += [(40 + k, f"A walk of {k} km along the river gave us two beetles.", "b") for k in range(6)]
    got = {r.doc_id for r in residue.residue(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == set(range(10)) | set(range(20, 26))
