from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from prismlake import ordering
from prismlake.llm import line_dedup, quality_rules

from ..oracle import compare

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_base_counts_agree_with_brute_force():
    rng = random.Random(1)
    texts = [None, "", " ", "\n\n", "a", "a b", "a b c", "a b c d", "x y \x1c z", "é#*$ é#*$ é#*$ é#*$"]
    for _ in range(300):
        texts.append("".join(rng.choice(["a", "b", "cé", " ", " ", "\n", "\t", "#", "\x0b", "|"]) for _ in range(rng.randrange(120))))
    texts.append("word " * 50_000)
    for text in texts:
        assert quality_rules.base_counts(text) == brute(text), text[:50] if text else text


def body(i):
    return " ".join(f"w{i}x{k}" for k in range(60))


def normal(line):
    return line.strip(" \t\r\x0b\x0c").lower()


def often(rows, least=quality_rules.LEAST, sites=quality_rules.SITES):
    """(source, line) and (all, line) above their limits, of rows (doc_id, text, source), by sets of distinct texts."""
    docs, totals = {}, Counter()
    for source, text in {(s, t or "") for _, t, s in rows}:
        totals[source] += 1
        for line in {normal(x) for x in text.split("\n") if 0 < len(x.encode().split()) <= quality_rules.LONG} - {""}:
            docs[source, line] = docs.get((source, line), 0) + 1
    every, hosts = Counter(), Counter()
    for (_, line), n in docs.items():
        every[line] += n
        hosts[line] += 1
    found = {(s, x) for (s, x), n in docs.items() if n > least and n * n > totals[s]}
    return found, {x for x, n in every.items() if hosts[x] >= sites and n > least and n * n > sum(totals.values())}


def removed(text, source, found):
    """The words of a text's frequent lines."""
    own, every = found
    lines = [x for x in (text or "").split("\n") if len(x.encode().split()) <= quality_rules.LONG]
    return sum(len(x.encode().split()) for x in lines if (source, normal(x)) in own or normal(x) in every)


def planted(rng):
    """Documents of several hosts: lines of one host and of all, copies of a text in their number, near copies with long lines, and depleted ones."""
    short = lambda tag, n: " ".join(f"{tag}{rng.randrange(n)}" for _ in range(12))
    menu, licence = [f"menu line {k} of host a with words" for k in range(12)], "licensed as everything here is"
    rows = []
    for i in range(120):
        host = rng.choice(["a", "a", "b", "c", None])
        lines = [short(f"x{i}y", 10**6) for _ in range(8)]
        if host == "a" and i % 2:
            lines += menu[:3]
        if i % 3 == 0:
            lines.insert(rng.randrange(4), licence.upper() + " ")
        rows.append((i, "\n".join(lines), host))
    rows += [(200 + i, "\n".join([*menu, short(f"d{i}z", 10**6)]), "a") for i in range(12)]  # little of their own
    copied = "\n".join(short("copy", 10**6) for _ in range(7))
    long = " ".join(f"long{rng.randrange(10**6)}" for _ in range(60))
    rows += [(300 + i, copied, "b") for i in range(40)] + [(400 + i, f"{long}\nedit {i}", "c") for i in range(40)]
    return [*rows, (500, "", "a"), (501, None, None), (None, rows[1][1], "a"), rows[1]]


@pytest.mark.parametrize("lines", [2_000_000, 0])
def test_the_query_rejects_what_is_depleted_and_agrees_with_brute_force_and_sql(spark, monkeypatch, tmp_path, lines):
    """Also where lists are too long to be sent."""
    monkeypatch.setattr(quality_rules, "LINES", lines)
    monkeypatch.setattr(ordering, "LEAST", 7)
    rows = planted(random.Random(2))
    spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert compare(spark, quality_rules.op4_quality_rules, quality_rules.OP4_SQL, str(tmp_path)) == len(rows)
    table = spark.read.parquet(str(tmp_path / "documents.parquet"))
    found = often(rows)
    assert found[0] and found[1]
    by = Counter((r.doc_id, r.kept, r.base_failed, r.removed_words) for r in quality_rules.apply_rules(table).collect())
    want = Counter()
    for i, text, source in rows:
        n, _, _, _, again = brute(text)
        failed, gone = n < 50 or 100 * again > 50 * n, removed(text, source, found)
        want[i, not failed and n - gone >= quality_rules.LEFT * n, failed, gone] += 1
    assert by == want
    verdict = {i: kept for i, kept, _, _ in by}
    assert not any(verdict[200 + i] for i in range(12)) and all(verdict[300 + i] and verdict[400 + i] for i in range(40)) and all(verdict[i] for i in range(120))


def test_lines_above_a_limit_go_and_depleted_documents_are_rejected(spark):
    banner = "\n".join(" ".join(f"banner{k}" for k in range(i, i + 25)) for i in range(0, 100, 25))
    rows = [(i, f"Shared {chr(32) * (i % 3)}\n{body(i)}", "en", "a", 0) for i in range(40)]
    rows += [(100 + i, f"{body(i + 100)}\n{banner}\n{banner.upper()} ", "en", "b", 0) for i in range(30)]
    rows += [(200, "", "en", "a", 0), (201, None, None, None, None), (202, body(202), "en", "c", 0), (202, body(202), "en", "c", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "true AS kept", "1 AS host")
    found = {r.doc_id: r for r in quality_rules.apply_rules(docs, least=5).collect()}
    assert quality_rules.apply_rules(docs).count() == len(rows)
    assert all(found[i].kept and found[i].clean_text == body(i) and found[i].removed_words == 1 for i in range(40))
    assert all(not found[100 + i].kept and not found[100 + i].base_failed and found[100 + i].removed_words == 200 for i in range(30))
    assert not found[200].kept and not found[201].kept and found[201].n_words == 0 and found[202].kept
    assert found[202].host == 1
    assert quality_rules.apply_rules(docs.where("false")).count() == 0


def test_line_dedup_drops_what_a_site_repeats(spark):
    rows = [(i, f"Home | About\n{body(i)}\n home | about ", "en", "a", 0) for i in range(10)]
    rows += [(50 + i, f"Home | About\n{body(50 + i)}", "en", "b", 0) for i in range(5)]
    rows += [(90, None, None, None, None), (91, "", None, "a", 0), (92, " \n\n", None, "a", 0), (0, f"Home | About\n{body(0)}\n home | about ", "en", "a", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS n_lines")
    found = line_dedup.drop_boilerplate(docs).collect()
    assert len(found) == len(rows)
    by = {r.doc_id: r for r in found}
    assert all(by[i].text == body(i) and by[i].n_lines == 3 and by[i].n_dropped == 2 for i in range(10))
    assert all(by[50 + i].n_dropped == 0 and by[50 + i].text.startswith("Home") for i in range(5))
    assert by[90].text is None and by[90].n_lines == 0 and by[91].text == "" and by[92].text == " \n\n"
    assert line_dedup.drop_boilerplate(docs.where("false")).count() == 0


@pytest.mark.parametrize("hosts", [20_000, 0])
def test_pages_are_grouped_by_the_host_of_their_url(spark, monkeypatch, hosts):
    """Also where lists are too many to be sent, and documents are dealt by host."""
    monkeypatch.setattr(quality_rules, "LINES", hosts)
    monkeypatch.setattr(line_dedup, "HOSTS", hosts)
    monkeypatch.setattr(ordering, "LEAST", 7)
    rows = [(i, f"http://{'ab'[i % 2]}.org/x/{i}", f"menu\n{body(i)}" if i % 2 else body(i)) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, text string").selectExpr("*", "parse_url(url, 'HOST') AS host")
    found = line_dedup.drop_boilerplate(pages, site="host").collect()
    assert all(r.text == body(r.page_id) and r.n_dropped == r.page_id % 2 for r in found)
    ruled = quality_rules.apply_rules(pages, least=5, site="host").collect()
    assert all(r.removed_words == r.page_id % 2 and r.kept for r in ruled)
