import random

import numpy as np

from slotlake.llm import leak, subjects


def words(rng, n, stock):
    return [rng.choice(stock) for _ in range(n)]


def test_common_subsequence():
    rng = random.Random(4)
    for _ in range(60):
        a = [rng.randrange(6) for _ in range(rng.randrange(1, 70))]
        b = [x for x in (rng.randrange(6) for _ in range(rng.randrange(0, 90))) if x in a]
        row = [0] * (len(b) + 1)
        for x in a:
            row = _lcs_row(row, x, b)
        mask: dict = {}
        for k, t in enumerate(a):
            mask[t] = mask.get(t, 0) | 1 << k
        assert leak.common_subsequence(mask, len(a), b) == row[-1]


def _lcs_row(row, x, b):
    new = [0]
    for j, y in enumerate(b):
        new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
    return new


def test_words():
    assert leak.words("A '''Bold'''<ref name=\"x\">no</ref> [[Link|text]] &nbsp; «été»<!-- gone --> x_1{{cn}}") == [w.encode() for w in "a bold link text été x_1".split()]
    assert leak.answer_words("In 1828, Tazepra met the Cello. Then Nobody") == {b"1828", b"tazepra", b"cello", b"nobody"}


def leak_tables(seed=0):
    rng = random.Random(seed)
    stock = [f"w{k}" for k in range(400)]
    names = lambda: f"N{rng.randrange(10**6)}"
    items = []
    for k in range(12):
        items.append((k, " ".join(w if rng.random() < 0.8 else names() for w in words(rng, 80, stock))))
    docs, want = [], set()
    for k in range(300):
        body = words(rng, rng.randrange(0, 300), stock)
        kind = k % 10
        item = rng.randrange(12)
        text = items[item][1].split()
        at = rng.randrange(len(body) + 1)
        if kind == 0:
            docs.append((k, " ".join(body[:at] + text + body[at:])))
            want.add((k, item))
        elif kind == 1:
            s = rng.randrange(len(text) - 52)
            part = [w.upper() + rng.choice(["", ",", "\n", " {{cn}}", "<ref>u</ref>"]) for w in text[s : s + 52]]
            docs.append((k, " ".join(body[:at] + part + body[at:])))
            want.add((k, item))
        elif kind == 2:
            part = [w if rng.random() < 0.9 else "changed" for w in text]
            docs.append((k, " ".join(body[:at] + part + body[at:])))
            want.add((k, item))
        elif kind == 3:
            docs.append((k, " ".join(body[:at] + text[:20] + body[at:])))
        elif kind == 4:
            docs.append((k, " ".join(body + sorted(text, key=lambda w: rng.random()))))
        else:
            docs.append((k, " ".join(body)))
    return items, docs, want


def test_leaks_against_planted(frame):
    items, docs, want = leak_tables()
    docs += [(400, ""), (401, None), (None, items[0][1]), docs[0]]
    d = frame("doc_id long, text string, item_id long, terms string", [(*x, 1, "x") for x in docs])
    i = frame("item_id long, text string", [*items, (None, "a b c"), (50, None), (51, ""), items[0]])
    got = {(r.doc_id, r.item_id) for r in leak.leaks(d, i).collect()}
    assert got - want == set()
    assert len(got & want) >= 0.97 * len(want)


def test_leaks_empty(frame):
    d, i = frame("doc_id long, text string", []), frame("item_id long, text string", [(1, "one two three")])
    assert leak.leaks(d, i).count() == 0
    assert leak.leaks(frame("doc_id long, text string", [(1, "one two three")]), frame("item_id long, text string", [])).count() == 0
    assert leak.leaks(frame("doc_id long, text string", [(1, ""), (2, None)]), i).count() == 0
    assert [tuple(r)[:2] for r in leak.leaks(frame("doc_id long, text string", [(1, "One, two - three!"), (2, "four")]), i).collect()] == [(1, 1)]


def test_candidates_reach_brute_force_recall(frame):
    """The cosine search loses no pair that the word checks would confirm."""
    items, docs, _ = leak_tables(7)
    d, i = frame("doc_id long, text string", docs), frame("item_id long, text string", items)
    with_search = {(r.doc_id, r.item_id) for r in leak.leaks(d, i).collect()}
    everything = {(r.doc_id, r.item_id) for r in leak.leaks(d, i, cosine=-2.0).collect()}
    assert len(with_search & everything) >= 0.9 * len(everything) and everything


TOPICS = {"music": ["sonata", "violin", "choir", "tempo"], "law": ["court", "appeal", "statute", "verdict"], "food": ["flour", "broth", "cake", "menu"]}


def subject_tables(n=400, seed=5):
    rng = random.Random(seed)
    docs, labels, truth = [], [], set()
    for k in range(n):
        share = rng.choice([("music",), ("law",), ("law",), ("food",), ("food",), ("law", "food")])
        text = []
        counts: dict = {}
        for _ in range(rng.randrange(4, 14)):
            s = rng.choice(share)
            if rng.random() < 0.2:
                text.append("The meeting of the day was long and in the hall.")
                continue
            counts[s] = counts.get(s, 0) + 1
            text.append(f"In the {rng.choice(['old', 'new'])} house the {rng.choice(TOPICS[s])} was set by a {rng.choice(TOPICS[s])}.")
        total = sum(counts.values())
        own = {s for s, c in counts.items() if total and c >= total / 4}
        truth |= {(k, s) for s in own}
        docs.append((k, " ".join(text), rng.choice(["a", "b", None])))
        if k % 2 == 0:
            for s in own:
                if rng.random() < 0.92:
                    labels.append((k, rng.choice([s, s.upper(), f" {s} "]), "r1"))
            if rng.random() < 0.05:
                labels.append((k, rng.choice(list(TOPICS)), "r2"))
    return docs, labels, truth


def test_subjects(frame):
    docs, labels, truth = subject_tables()
    docs += [(900, "#REDIRECT [[X]]", "a"), (901, "", "a"), (902, None, None), (903, "???????", "b"), (None, docs[0][1], "a"), (904, "{|\n|-\n| [[A]] || sonata || 1900\n|-\n| [[B]] || violin || \n|}", "a")]
    labels += [(1, None, "r1"), (None, "law", "r1"), (3, "astrology", "r1"), labels[0]]
    d = frame("doc_id long, text string, source string, subject string", [(*x, "clash") for x in docs])
    s = frame("subject string, about string", [(t, "") for t in TOPICS] + [(None, "")])
    got = {tuple(r) for r in subjects.subjects_of(d, s, frame("doc_id long, subject string, rater string", labels)).collect()}
    assert {x for x in got if x[0] in (900, 901, 902, 903)} == set() and (904, "music") in got
    mine = {x for x in got if x[0] < 900}
    assert len(mine & truth) >= 0.97 * len(truth) and len(mine & truth) >= 0.97 * len(mine)


def test_subjects_empty(frame):
    d = frame("doc_id long, text string, source string", [(1, "a sonata.", "x")])
    s, none = frame("subject string, about string", [("music", "")]), frame("doc_id long, subject string, rater string", [])
    assert subjects.subjects_of(d, s, none).count() == 0
    assert subjects.subjects_of(d, frame("subject string, about string", []), none).count() == 0
    assert subjects.subjects_of(frame("doc_id long, text string, source string", []), s, frame("doc_id long, subject string, rater string", [(1, "music", "r")])).count() == 0


def test_beam_search_is_exact_when_wide():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    y = (rng.random((300, 3)) < 0.4).astype(float)
    x = np.hstack([y + rng.normal(0, 0.7, y.shape), y, rng.random((300, 3)), rng.random((300, 2))])
    c = subjects.Chain(x, y)
    wide = c.decode(x, beam=8)
    for k in range(0, 300, 30):
        best = None
        for combo in itertools.product([0.0, 1.0], repeat=3):
            total = 0.0
            for j, s in enumerate(c.order):
                z = np.hstack([subjects._own(x[k : k + 1], s, 3), [[combo[t] for t in c.order[:j]]]])
                logit = c.scale[j][0] * (z @ c.weights[j][:-1] + c.weights[j][-1])[0] + c.scale[j][1]
                total += -np.logaddexp(0, -logit if combo[s] else logit)
            if best is None or total > best[0]:
                best = (total, combo)
        assert tuple(wide[k].astype(float)) == best[1]


def misread_tables(n=600, seed=8):
    """Source b always writes of food as well, in words found once only, which no lexicon has; its raters say food."""
    rng = random.Random(seed)
    once = lambda: "".join(rng.choice("bcdfgjkz") for _ in range(12))
    docs, labels, truth = [], [], set()
    for k in range(n):
        source = "b" if k % 6 == 0 else "a"
        read = (rng.choice(["music", "law"]),) if source == "b" else rng.choice([("music",), ("law",), ("law",), ("food",), ("food",), ("law", "food")])
        text = [f"In the {rng.choice(['old', 'new'])} house the {rng.choice(TOPICS[s])} was set by a {rng.choice(TOPICS[s])}." for s in read for _ in range(4)]
        text += [f"In the house the {once()} was set by a {once()}." for _ in range(4) if source == "b"]
        rng.shuffle(text)
        docs.append((k, " ".join(text), source))
        own = {*read, "food"} if source == "b" else set(read)
        truth |= {(k, s) for s in own}
        if k % 4:
            labels += [(k, s, "r1") for s in sorted(own) if rng.random() < 0.93]
    return docs, labels, truth


def test_chain_corrects_the_lexicon_from_the_labels(frame):
    docs, labels, truth = misread_tables()
    d, s = frame("doc_id long, text string, source string", docs), frame("subject string, about string", [(t, "") for t in TOPICS])
    got = {tuple(r) for r in subjects.subjects_of(d, s, frame("doc_id long, subject string, rater string", labels)).collect()}
    assert len(got & truth) >= 0.97 * len(truth) and len(got & truth) >= 0.97 * len(got)


def test_chain_follows_the_labels(frame):
    docs, labels, truth = subject_tables()
    d, s = frame("doc_id long, text string, source string", docs), frame("subject string, about string", [(t, "") for t in TOPICS])
    names, own = sorted(TOPICS), subjects.learn_lexicon([x[1] for x in docs], np.array([[float((k, t) in truth) for t in sorted(TOPICS)] for k, *_ in docs]))
    x, total = subjects.features(own, [x[1] for x in docs], [x[2] for x in docs], ["a", "b"])
    y = np.array([[float((k, t) in truth) for t in names] for k, *_ in docs])
    some = total > 0
    right = subjects.Chain(x[some], y[some]).decode(x[some])
    assert (right == (y[some] > 0)).all(axis=1).mean() > 0.97
    # The chain has nothing but the labels to learn from: other labels, other subjects.
    other = np.random.default_rng(1).permutation(y[some])
    assert (subjects.Chain(x[some], other).decode(x[some]) == right).all(axis=1).mean() < 0.7
    # A document needs half of the sentences if the raters say so.
    half = (x[some][:, : len(names)] >= 0.5).astype(float)
    assert (subjects.Chain(x[some], half).decode(x[some]) == (half > 0)).all(axis=1).mean() > 0.97
    assert subjects.fit(d, frame("doc_id long, subject string, rater string", labels), names)[1] is not None
    assert subjects.sample(d, frame("doc_id long, subject string, rater string", labels), names, most_bytes=2000).count() < 40


def test_half_in_one_piece_needs_no_names(frame):
    rng = random.Random(3)
    named = " ".join(f"N{k}x" if k % 4 == 1 else f"a{chr(97 + k // 7)}{chr(97 + k % 7)}" for k in range(38))
    plain = [f"b{chr(97 + k // 7)}{chr(97 + k % 7)}" for k in range(42)]
    filler = lambda n: " ".join(f"f{rng.randrange(500)}" for _ in range(n))
    i = frame("item_id long, text string", [(1, f"{named} {' '.join(plain)}")])
    docs = [(1, f"{filler(90)} {' '.join(plain)} {filler(90)}"), (2, f"{filler(90)} {' '.join(w if k % 6 else w + ' ' + filler(1) for k, w in enumerate(plain))} {filler(90)}")]
    docs += [(k, filler(300)) for k in range(10, 200)]
    assert {r.doc_id for r in leak.leaks(frame("doc_id long, text string", docs), i).collect()} == {1}


def test_glue_window_does_not_hide_a_leak():
    import numpy as np

    word = lambda k: chr(97 + k // 26) + chr(97 + k % 26)
    # Every fifth word of the item is a name. The glue has 56 words and 2 of 20 names, the leak 54 and 12; no runs.
    item = [f"N{word(k)}" if k % 5 == 4 else word(k) for k in range(100)]
    its = leak.Items([(1, "Start " + " ".join(item[1:]))])
    named, plain = [k for k in range(100) if k % 5 == 4], [k for k in range(1, 100) if k % 5 != 4]
    glue, true = sorted(named[:2] + plain[:54]), sorted(named[:12] + plain[:42])

    def checked(*parts):
        at, terms, places = 0, [], []
        for part in parts:
            for j, k in enumerate(part):
                terms.append(its.terms[0][k])
                places.append(at + j + j // 4)
            at += 400
        return leak._check(its, 0, np.array(terms, dtype=np.int32), np.array(places, dtype=np.int32), 0, at)

    assert not checked(glue)[0] and checked(true)[0]
    assert checked(glue, true)[0] and checked(true, glue)[0]


def test_blocks_of_items_and_pieces_of_short_ones(frame):
    """Pieces of short and long items, against an exhaustive search (every passage a candidate); the same in blocks of items."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3))
    stock = [word() for _ in range(3000)]
    items, docs, planted = [], [], set()
    for i, n in enumerate([8, 8, 8, 8, 12, 12, 12, 12, 30, 30, 70, 70, 120, 400]):
        text = [word() for _ in range(n)]
        items.append((i, " ".join(text)))
        for k in range(4):
            part = text if k == 0 else text[: max(1, round(0.65 * n))] if k % 2 else text[n - round(0.65 * n) :]
            d = len(docs)
            docs.append((d, " ".join(rng.choices(stock, k=rng.randrange(20, 400)) + part + rng.choices(stock, k=rng.randrange(20, 400)))))
            planted.add((d, i))
    docs += [(1000 + k, " ".join(rng.choices(stock, k=300))) for k in range(60)]
    d, t = frame("doc_id long, text string", docs), frame("item_id long, text string", items)
    pairs = lambda df: {(r.doc_id, r.item_id) for r in df.collect()}
    every = pairs(leak.leaks(d, t, cosine=-2.0))
    assert every == planted
    assert len(pairs(leak.leaks(d, t)) & every) >= 0.95 * len(every)
    assert len(pairs(leak.leaks(d, t, block=5)) & every) >= 0.95 * len(every)
    assert leak.spans([49, 64, 65, 127, 128]) == [2, 4] and leak.spans([8, 129, 400]) == [1, 2, 4, 8, 16]
