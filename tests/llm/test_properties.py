"""What holds for any text, histogram or payload."""

from __future__ import annotations

from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from prismlake.llm import classifier, media, packing, quality_rules, simhash, suffix_dedup

from .test_quality_rules import brute
from .test_simhash import brute_fingerprint

some = settings(max_examples=150, deadline=None)
texts = st.text(st.one_of(st.sampled_from("aAbB \n\t\x0b\x1c#|é"), st.characters(exclude_categories=["Cs"])), max_size=400)


@some
@given(texts)
def test_counts_and_fingerprints_are_those_of_brute_force(text):
    assert quality_rules.base_counts(text) == brute(text)
    assert simhash.fingerprint(text) == brute_fingerprint(text)
    assert np.isfinite(classifier.features(text)).all()


@some
@given(st.binary(max_size=900))
def test_payloads_come_back_from_their_image(raw):
    payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
    stored = media.to_png(payload)
    assert media.from_png(stored) == payload and media.to_png(payload) == stored
    assert media.feature(payload).count(",") == 3


@some
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 10**7), max_size=40))
def test_patterns_hold_any_histogram(histogram):
    patterns, count = packing.shortest_pack_first(histogram, 64)
    held = Counter()
    for n, runs in patterns:
        assert sum(k * times for k, times in runs) <= 64
        for k, times in runs:
            held[k] += n * times
    assert held == Counter(histogram) and count == sum(n for n, _ in patterns) and len(patterns) <= 3 * 64
    for k, slots in packing.slots_of(patterns).items():
        assert slots.first[0] == 0 and slots.first == sorted(slots.first) and max(slots.first) < histogram[k]


@some
@given(st.binary(min_size=200, max_size=700), st.integers(1, 40))
def test_every_string_has_one_trigger_that_its_bytes_decide(raw, period):
    for text in (raw, raw[:period] * (600 // period)):
        if len(text) < 200:
            continue
        rows = suffix_dedup.triggers(text, suffix_dedup.Hashes(text))
        owner = {i: t - i for t, low, high in rows.tolist() for i in range(low, high + 1)}
        assert sorted(owner) == [*range(len(text) - 199)]
        seen = {}
        for i, far in owner.items():
            assert seen.setdefault(text[i : i + 200], far) == far


@some
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(1, 30))))
def test_merged_spans_cover_the_same_bytes_and_never_touch(pairs):
    runs = suffix_dedup._runs(np.array([s for s, _ in pairs], np.int64), np.array([s + n for s, n in pairs], np.int64))
    assert {i for s, e in runs for i in range(s, e)} == {i for s, n in pairs for i in range(s, s + n)}
    assert all(a[1] < b[0] for a, b in zip(runs, runs[1:], strict=False))
