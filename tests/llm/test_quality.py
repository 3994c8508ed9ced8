import random

import numpy as np
import pytest

from terraloom.llm import quality as q

SCHEMA = "doc_id bigint, text string, form string, lang string"
PROSE = ["She said that the ledger from the valley would have been quiet, if the antenna had not been so steep.", "It is hard to say why the gauge avoided so many of the people who live there.", "After 158 days the quarry was covered, and then we went back to the gateway to see what was left."]
NOUNS = "ledger valley antenna quarry gauge gateway camera tripod meadow signal".split()


def corpus(n=240):
    rng = random.Random(0)
    docs = {i: " ".join(rng.choice(PROSE) for _ in range(rng.randint(4, 12))) for i in range(n)}
    bullet = ["- ", "* ", "", "[x] "]
    want = {}
    for k in range(12):
        b = bullet[k % 4]
        docs[1000 + k] = "\n".join(f"{b}{rng.choice(NOUNS)} and {rng.choice(NOUNS)}" for _ in range(30))
        want[1000 + k] = "list"
        sep = ["|", ";", "\t"][k % 3]
        edge = "| " if sep == "|" else ""
        docs[2000 + k] = "\n".join(edge + f" {sep} ".join([rng.choice(NOUNS), str(rng.randint(1, 9999)), f"{rng.randint(1, 99)} %", "-"]) + (" |" if edge else "") for _ in range(25))
        want[2000 + k] = "table"
        junk = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(900)), "\n".join("".join(rng.choice("ABCDEFabcdef0123456789+/") for _ in range(76)) for _ in range(12)), "\n".join(".c%d{margin:%dpx;color:#fff}" % (i, i) for i in range(20)), "\n".join("=" * rng.randint(20, 60) for _ in range(20)), "\n".join(" ".join(rng.choice(NOUNS[:4]) for _ in range(12)) for _ in range(12))]
        docs[3000 + k] = junk[k % 5]
        want[3000 + k] = "junk"
    return docs, want


def run(spark, docs):
    df = spark.createDataFrame([(k, t, "x", "y") for k, t in docs], SCHEMA)
    return q.outlierness(df, "doc_id", "text")


def test_forms(spark):
    docs, want = corpus()
    got = {r.doc_id: r.form for r in run(spark, docs.items()).collect() if r.form}
    assert got == want


def test_contributions_add_up_and_prose_is_near(spark):
    docs, _ = corpus()
    rows = run(spark, docs.items()).collect()
    for r in rows:
        assert sum(r[f"d_{s}"] for s in q.STATS) == pytest.approx(r.distance2, rel=1e-6, abs=1e-6)
    assert np.median([r.distance2 for r in rows if r.doc_id < 1000]) < q.CUTOFF


def test_dirt(spark):
    docs, _ = corpus(60)
    extra = [(5000, None), (5001, ""), (5002, " \t\n "), (5003, PROSE[0] * 3000), (5004, "x"), (5005, "​"), (None, PROSE[0]), (0, docs[0])]
    rows = run(spark, [*docs.items(), *extra]).collect()
    ids = [r.doc_id for r in rows]
    assert len(ids) == len(set(ids)) and {5000, 5001, 5002, 5005}.isdisjoint(ids) and {5003, 5004} <= set(ids)


def test_empty(spark):
    assert run(spark, []).count() == 0


@pytest.mark.parametrize("text, want", [("Ã¼ber", "über"), ("cafÃ© plain", "café plain"), ("Ðк", "Ðк"), ("Ã", "Ã")])
def test_mend(text, want):
    assert q.mend(text) == want


def test_frequent_lines_are_no_content(spark):
    docs, _ = corpus(100)
    menu = "\n".join(["Home", "Contact", "Archive", "Search"] * 1)
    rows = [(k, f"{menu}\n{t}" if k < 100 else t) for k, t in docs.items()]
    rows.append((7000, menu + "\n" + "\n".join(PROSE)))
    rows += [(7100 + k, f"{menu}\nThis page is gone.\n© 20{k:02d} Wick{k}") for k in range(20)]  # nothing but menu, message and footer
    got = {r.doc_id: r.form for r in run(spark, rows).collect()}
    assert got[7000] is None and all(got[7100 + k] is None for k in range(20))


def test_mirrored_pages_keep_their_form(spark):
    rng = random.Random(3)
    docs = {i: " ".join(rng.choice(PROSE) for _ in range(rng.randint(4, 12))) + f" Then {rng.choice(NOUNS)} {i} was seen." for i in range(240)}
    menu = "\n".join(["Home", "Contact", "Archive", "Search"])
    page = "\n".join(f"- {a} and {b}" for a in NOUNS[:6] for b in NOUNS[:5])
    scrambled = "\n".join(" ".join("".join(rng.sample("abcdefghijklmnopqrstuvwxyz", 7)) for _ in range(12)) for _ in range(8))
    rows = [(k, f"{menu}\n{t}" if k < 100 else t) for k, t in docs.items()]
    rows += [(1000 + k, page) for k in range(120)]  # a third of all rows
    rows += [(2000 + k, scrambled) for k in range(30)]
    rows += [(3000 + k, f"{menu}\n{page}\nMirror host{k}") for k in range(30)]  # copies that differ in a line
    got = {r.doc_id: r.form for r in run(spark, rows).collect() if r.form}
    assert got == {1000 + k: "list" for k in range(120)} | {2000 + k: "junk" for k in range(30)} | {3000 + k: "list" for k in range(30)}


def test_partly_repeated_lists_keep_their_items():
    frequent = frozenset(["Home", "Contact", *NOUNS[2:]])
    _, lines, _ = q.describe("\n".join(["Home", NOUNS[0], *NOUNS[2:], NOUNS[1], "Contact"]), frequent)
    assert lines[:, 0].sum() == sum(map(len, NOUNS))
