import hashlib
import random
import re
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from recallgrid.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def by_pattern(text):
    digits = lambda s: [int(c) for c in s if c in "0123456789"]
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        d = digits(m.group())
        doubled = [x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(reversed(d))]
        if 14 <= len(d) <= 19 and sum(doubled) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m.group())) <= 15]
    return sorted(out)


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="ab@.-_+ 0129()%\né", max_size=60))
def test_base_spans_are_those_of_the_patterns(text):
    assert pii.base_spans(text) == by_pattern(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["4111 1111 1111 1111", "4111111111111111", "1.2.3.4", "300.1.1.1", "+1 (017) 555-7713", "a@b.c", "a@b.c@d.e", "_x@y.z", "7", " ", "-", "é", "+", ".", "12345678901234"]), max_size=14))
def test_base_spans_of_joined_parts(parts):
    text = "".join(parts)
    assert pii.base_spans(text) == by_pattern(text)


def test_long_odd_texts_take_no_long_time():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1" + " (" * 100_000, "a@" * 100_000, "1 " * 100_000):
        pii.redacted_text(text, pii.prior())


def added(text, weights=None):
    base = pii.base_spans(text)
    return [(pii.KINDS[k], text[a:b]) for a, k, b in pii.added_spans(text, base, pii.prior() if weights is None else weights)]


def test_added_spans():
    assert added("call (217) 555-7713 now") == [("phone", "(217) 555-7713")]
    assert added("card 4111.1111.1111.1111 is") == [("card", "4111.1111.1111.1111")]
    assert added("write to jo.doe (at) mail7.example (dot) com today") == [("email", "jo.doe (at) mail7.example (dot) com")]
    assert added("tel 217-555-7713, fax 217.555.7714") == [("phone", "217-555-7713"), ("phone", "217.555.7714")]


def test_clean_texts_get_none():
    for text in (
        "On 2024-01-01 12:30:45 the total was 1,234,567.89 or 12 345 678",
        'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"',
        "He sat at home. Look at this dot there. 9807915762804491",
        "pages 100-120, 130-140 and 150-160; 1999/2000/2001",
        "4785380592391135$$$ isbn 978-3-16-148410-0",
    ):
        assert added(text) == [], text


def test_dynamic_programme_is_the_best_choice():
    rng = np.random.default_rng(4)
    for _ in range(60):
        cuts = sorted(rng.choice(40, 6, replace=False).tolist())
        region = [(a, b, int(rng.integers(4)), rng.standard_normal(len(pii.FEATURES))) for a in cuts for b in cuts if a < b]
        weights = rng.standard_normal((4, len(pii.FEATURES)))
        value = {(a, k, b): float(weights[k] @ x) - pii.MARGIN for a, b, k, x in region}

        def top(at):
            return max([0.0, *(v + top(b) for (a, _, b), v in value.items() if a >= at)])

        got = sum(value[s] for s in pii.best(region, weights))
        assert got == pytest.approx(top(0))


def by_region(text, base, weights):
    """The best segmentation of each whole region, less what touches a base span."""
    found = [s for region in pii.candidates(text) for s in pii.best(region, weights)]
    return sorted((a, k, b) for a, k, b in found if all(b <= x or y <= a for x, _, y in base))


def test_clusters_give_the_best_segmentation_of_the_region():
    rng, pick, n = np.random.default_rng(6), random.Random(6), 0
    parts = ["12", "555", "1234", "4111 1111 1111 1111", "+", "(", ") ", ".", "-", " ", "  ", "192.168.0.1", "call ", "a", "card ", "@", "me (at) x (dot) com", "j at a dot de ", "5" * 30]
    for _ in range(800):
        text = "".join(pick.choice(parts) for _ in range(pick.randint(1, 50)))
        weights, base = pii.prior() + rng.normal(0, 1.5, pii.prior().shape), pii.base_spans(text)
        got = sorted(pii.added_spans(text, base, weights))
        assert got == by_region(text, base, weights)
        n += len(got)
    assert n > 1000


def test_long_lists_of_numbers_take_little_memory():
    pick = random.Random(7)
    text = " ".join(str(pick.randint(1, 9999)) for _ in range(60_000)) + " (217) 555-7713"
    base = pii.base_spans(text)
    tracemalloc.start()
    found = pii.added_spans(text, base, pii.prior())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # Once 960,000 candidates of a tenth of this text took 435 MB.
    assert peak < 5e6 and len(found) <= 1


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(5)
    text = "x +1 (217) 555-7713 12 y"
    region = max(pii.candidates(text), key=len)
    gold = {(region[3][0], region[3][2], region[3][1])}
    weights = pii.prior() * 0.1
    _, gradient = pii._gradient(region, gold, weights)
    for _ in range(10):
        k, f = int(rng.integers(4)), int(rng.integers(len(pii.FEATURES)))
        step = np.zeros_like(weights)
        step[k, f] = 1e-5
        slope = (pii._gradient(region, gold, weights + step)[0] - pii._gradient(region, gold, weights - step)[0]) / 2e-5
        assert slope == pytest.approx(gradient[k, f], abs=1e-4)


def test_training_keeps_what_it_was_shown():
    rng = random.Random(2)
    windows = []
    for _ in range(40):
        number = f"+1 ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)}"
        text = f"thon onre {number} reth anea"
        windows.append((text, pii.base_spans(text)))
    weights = pii.train(windows)
    assert added("the (345) 555-1234 ere", weights) == [("phone", "(345) 555-1234")]
    assert added("On 2024-01-01 12:30:45 the", weights) == []


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    for r in docs.collect():
        base, g = by_pattern(r.text), got[r.doc_id]
        assert g.base_sha256 == hashlib.sha256(pii.shown(base).encode()).hexdigest()
        assert [g.n_email, g.n_ip, g.n_card, g.n_phone] == [sum(k == n for _, k, _ in base) for n in range(4)]
        assert set(pii.shown(base).split(",")) <= {*g.spans.split(","), ""}


def test_odd_rows(documents, odd):
    got = pii.personal_data(documents(odd)).collect()
    assert len(got) == len(odd) and all(r.spans == "" for r in got)
    assert pii.personal_data(documents([])).count() == 0
    clean = pii.redact(documents([*odd, (50, "Mail a@b.co or +1 (217) 555-7713.")]))
    rows = {r.doc_id: r for r in clean.collect()}
    assert rows[50].text == "Mail <EMAIL> or <PHONE>." and rows[1].text is None and rows[50].votes == "y"
