import hashlib
import random
import re

import numpy as np

from lumenspark.llm import pii

PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def brute(text):
    def good(kind, m):
        digits = re.sub("[^0-9]", "", m)
        if kind == 1:
            return all(int(x) <= 255 for x in m.split("."))
        if kind == 2:
            total = sum(int(d) if i % 2 == 0 else sum(map(int, str(2 * int(d)))) for i, d in enumerate(reversed(digits)))
            return 13 <= len(digits) <= 19 and total % 10 == 0
        return kind == 0 or 9 <= len(digits) <= 15

    return [(k, m.start(), m.end()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text) if good(k, m[0])]


def test_base_equals_patterns():
    rng = random.Random(0)
    texts = ["@a.b@c.d", "a@b.c@d.e x@y", "..@-.-", "1.2.3.4.5.6.7.8.9", "256.1.1.1 001.02.3.255", "4111 1111 1111 1111", "4111-1111-1111-1111-", "+1 (555) 123-4567 +33()..--1", "é4111111111111111é", "a" * 5000 + "@", "1" * 3000, "1." * 2000, "+" * 900 + "1" * 900]
    for alphabet in ("0123456789. -+()", "ab@.-1 ", "14 -", "+1( )"):
        texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(1500)]
    for text in texts:
        assert pii.base_spans(text) == brute(text), text[:100]


def test_field_finds_other_guises_and_leaves_numbers_alone():
    field = pii.trained()
    want = {
        "call (852) 555-5043 now": ["phone (852) 555-5043"], "write bob at mail dot com ok": ["email bob at mail dot com"], "x 4785.3805.9239.1139 y": ["card 4785.3805.9239.1139"],
        "ip 2001:db8:1:2::7 x": ["ip 2001:db8:1:2::7"], "on 2024-01-15 10:20:30 it": [], "ISBN 978-3-16-148410-0": [], "we meet at noon": [], "id 1234567890": [], "pi 3.14159265358979": [],
        "qui 63.209.204.192 4588641552771464 et": ["card 4588641552771464", "ip 63.209.204.192"],
    }
    for text, spans in want.items():
        assert sorted(f"{pii.KINDS[k]} {text[a:b]}" for k, a, b in pii.spans(text, field)) == sorted(spans), text


def test_new_templates_accuracy():
    rng = random.Random(99)  # not the training seed
    field = pii.trained()
    right = wrong = missed = 0
    for text, gold in pii._sentences(rng):
        found = {(k, a, b) for part in pii.parts_of(text, pii.places_of(text)) for k, a, b in field.best(part)}
        right += len(found & set(gold))
        wrong += len(found - set(gold))
        missed += len(set(gold) - found)
    assert right / (right + wrong) > 0.97 and right / (right + missed) > 0.93, (right, wrong, missed)


def test_path_and_marginals_equal_enumeration():
    field = pii.trained()
    text = "tel 555-123-4567 4111 1111 1111 1111 x"
    part = pii.part_of(text, 0, len(text))
    part = pii.Part(part.tokens, part.segments[:14], part.features[:14])
    scores = field.scores(part)
    paths = [((), 0.0)]
    for s, (i, _) in enumerate(part.segments):
        for path, value in list(paths):
            if all(part.segments[q][1] < i or part.segments[s][1] < part.segments[q][0] for q, _ in path):
                paths += [(path + ((s, k),), value + scores[s, k]) for k in range(4)]
    total = np.logaddexp.reduce([v for _, v in paths])
    want = np.zeros_like(scores)
    for path, value in paths:
        for s, k in path:
            want[s, k] += np.exp(value - total)
    assert np.allclose(field.marginals(part, scores), want)
    best = max(paths, key=lambda p: p[1] - pii.MARGIN * len(p[0]))[0]
    assert field.best(part) == sorted(((k, part.tokens[part.segments[s][0]][0], part.tokens[part.segments[s][1]][1]) for s, k in best), key=lambda x: x[1])


def test_query_and_edges(spark):
    from lumenspark.llm.queries_e import op2_pii

    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = op2_pii(spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = brute(texts[r.doc_id])
        line = [f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x[0] == k for x in base) for k in range(4))
        assert r.base_sha256 == hashlib.sha256(",".join(line).encode()).hexdigest() and set(line) <= set(r.spans.split(","))
    docs = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "a@b.co", 3), (1, "a@b.co", 3)], "doc_id bigint, text string, spans int")
    got = pii.find(docs, ["doc_id"]).collect()
    assert sorted(len(r.spans) for r in got) == [0, 0, 1, 1] and pii.find(docs.where("false"), ["doc_id"]).count() == 0
