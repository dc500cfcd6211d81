import random
import re
import time
import tracemalloc

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="0123@.+- ()aB_é", max_size=60))
def test_base_spans_are_those_of_the_patterns(text):
    assert pii.base_spans(text) == plain(text)


def test_held_out_sentences():
    weights = pii.train()
    right = wanted = wrong = 0
    for text, spans in pii.sentences(200, 4711):
        got = {(a, b, k) for k, a, b in pii.added_spans(text, weights, [])}
        right, wanted, wrong = right + len(got & set(spans)), wanted + len(spans), wrong + len(got - set(spans))
    assert right >= 0.95 * wanted and wrong <= 0.05 * wanted


def test_plain_texts_stay_alone():
    weights = pii.train()
    for text in ("In 2019 it cost 12.50 or 300 in all, on 2020-01-02 at 12:30.", "the dot at the end", "order 4574487405351568 of 9807915762804491", "token 5f367f08b1a810c7777ad785b0be42018bfcbf49"):
        assert [s for s in pii.all_spans(text, weights)[1] if s not in plain(text)] == []


def best(region, w, out, trans):
    """Segments (i, j, kind) of the best reading, by a table of all segments."""
    seg, single = region.scores(w, out)
    n, labels = len(region.tokens), len(pii.KINDS) + 1
    value = {(0, 0): (0.0, None)}
    for j in range(1, n + 1):
        steps = [(value[p, y][0] + trans[y, 0] + single[j - 1], (p, y), (j, 0)) for p in (j - 1,) for y in range(labels) if (p, y) in value]
        for k in region.ending[j]:
            i = region.segments[k][0]
            steps += [(value[i, y][0] + trans[y, z] + seg[k][z - 1], (i, y), (j, z)) for y in range(labels) if (i, y) in value for z in range(1, labels)]
        for score, before, here in steps:
            if here not in value or score > value[here][0] + 1e-9:
                value[here] = (score, before)
    at, found = max((y for y in range(labels) if (n, y) in value), key=lambda y: value[n, y][0]), []
    at = (n, at)
    while at[0]:
        before = value[at][1]
        if at[1]:
            found.append((before[0], at[0], at[1] - 1))
        at = before
    return found[::-1]


def test_readings_are_the_best_of_all(monkeypatch):
    weights, rng = pii.train(), random.Random(3)
    monkeypatch.setattr(pii, "WINDOW", 16)
    for text, _ in pii.sentences(60, 99):
        text = " ".join([text, *(str(rng.randint(0, 10**rng.randint(1, 6))) for _ in range(rng.randint(0, 30)))])
        spans = [m.span() for m in pii._token.finditer(text)]
        assert pii.reading(text, *np.array(spans).T, weights) == best(pii.Region(text, spans), *weights)


def test_texts_of_numbers_take_linear_time_and_little_memory():
    weights, took = pii.train(), []
    for n in (500, 2_000):
        text = " ".join(str(k * 7919 % 100_000) for k in range(n))
        began = time.process_time()
        tracemalloc.start()
        pii.all_spans(text, weights)
        assert tracemalloc.get_traced_memory()[1] < 20 << 20
        tracemalloc.stop()
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0]


def test_numbers_of_thousands_of_digits():
    text = "0" * 5000 + ".1.2.3 and " + "9" * 5000 + ".1.2.3, " + "00300.1.1.1 " + "1" * 6000 + "@" + "2" * 6000 + ".de"
    assert [s for s in pii.base_spans(text) if s[0] == "ip"] == [("ip", 0, 5006)]
    pii.all_spans(text, pii.train())


def test_rows(spark, docs, odd, none):
    more = [(1, "mail a.b@c.de or ab at cd dot de, call +1 (017) 555-7713"), (2, None), (3, ""), (3, ""), (4, "1" * 50_000 + " 10.0.0.1"), (5, "4111 1111 1111 1111 é 1.2.3.4.5.6.7.8")]
    df = spark.createDataFrame([(i, t, "n") for i, t in more], "doc_id bigint, text string, base string")
    rows = {r.doc_id: r for r in pii.find(df).collect()}
    assert (rows[1].n_email, rows[1].n_phone, rows[2].base, rows[3].spans) == (1, 1, "", "")
    assert rows[1].base == "email:5:13,phone:39:56"
    assert rows[1].spans == "email:5:13,email:17:32,phone:39:56"
    assert (rows[4].n_ip, rows[5].n_card, rows[5].n_ip) == (1, 1, 2)
    clean = {r.doc_id: r for r in pii.redact(df).collect()}
    assert clean[1].text == "mail [EMAIL] or [EMAIL], call [PHONE]" and clean[2].text is None and clean[1].base == "n"
    assert pii.find(docs).count() == len(odd) and pii.redact(docs).columns == docs.columns
    assert pii.find(none).count() == 0 and pii.redact(none).count() == 0


def test_overlapping_spans_mask_once():
    assert pii.masked("abcdef", [("email", 1, 3), ("ip", 2, 5)]) == "a[EMAIL]f"
