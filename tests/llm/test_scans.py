"""Personal data, licences and SpotSigs against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import regex

from stallmark.llm import licenses, personal_data, spotsigs

KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind: str, value: str) -> bool:
    digits = [int(c) for c in value if c.isdigit() and c.isascii()]
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
        return 14 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def base(text: str | None) -> list[tuple]:
    return sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(KINDS.items())
                  for m in re.finditer(p, text or "") if valid(kind, m.group()))


def joined(spans: list[tuple]) -> str:
    return ",".join(f"{(*KINDS, 'id')[k]}:{a}:{b}" for a, k, b in spans)


def test_base_spans_of_random_texts(spark):
    rnd = random.Random(3)
    letters = list("0123456789") * 3 + list("..--  ()++@@aZ%_é😀\n,:=")
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 120))) for _ in range(800)]
    texts += [None, "", "a@b.c%x@y.z", "1.2.3.4.5.6.7.8 4041894974608795", "0001.2.3.00255 1.2.3.256", "+1 (409) 555-3724",
              " ".join(f"user{i}@x.com 10.0.0.{i % 256}" for i in range(2000)), "1" * 3000 + "@" + "a." * 2000 + "b", "1 " * 9000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in personal_data.span_digests(personal_data.personal_data(docs)).collect()}
    for i, text in enumerate(texts):
        want = base(text)
        assert got[i].base_sha256 == hashlib.sha256(joined(want).encode()).hexdigest(), text
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(s[1] == k for s in want) for k in range(4)]


def test_contexts_are_learnt(spark):
    rnd = random.Random(6)
    prose = "the river and the stone walk under a bright sky"
    rows = [(i, f"{prose} contact: user{i}@mail.example.com {prose}") for i in range(40)]
    rows += [(100 + i, f"{prose} contact: U-{rnd.randint(100000, 999999)} {prose}") for i in range(4)]
    # Behind a plain word most followers are no entities, so nothing is learnt from the few that are.
    rows += [(200 + i, f"under user{i}@mail.example.com and under 2{i}0-33X sky") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in personal_data.span_digests(personal_data.personal_data(docs)).collect()}
    for doc_id, text in rows:
        spans = base(text)
        if 100 <= doc_id < 200:
            m = re.search(r"U-\d+", text)
            spans = [(m.start(), 4, m.end())]
        assert got[doc_id] == joined(spans), text


def learnt(rows: list[tuple], confidence: float, support: int) -> tuple[dict, dict]:
    """Good contexts with their generations, and the added spans of each document, in plain Python."""
    def around(text: str, start: int, end: int) -> set:
        space = "[ \\n\\t\\r\\f\\v]+"
        before, after = re.split(space, text[:start].lower()), re.split(space, text[end:].lower())
        out = set()
        if not regex.search(r"[\p{L}\p{N}]", before[-1]):
            words = [w for w in before[:-1] if w]
            out |= {" ".join(words[-k:]) + " " for k in (1, 2, 3) if len(words) >= k}
        if not regex.search(r"[\p{L}\p{N}]", after[0]) and len(after) > 1 and after[1]:
            out.add(" " + after[1])
        return out

    edges, known, tokens, times = Counter(), set(), [], Counter()
    for doc_id, text in rows:
        words = text.lower().split()
        times.update(" ".join(words[i:i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1))
        spans = base(text)
        for start, _, end in spans:
            known.add(text[start:end])
            edges.update((c, text[start:end]) for c in around(text, start, end))
        for m in re.finditer(r"(?<!\S)[^\s0-9@]*[0-9@]\S*", text):
            if any(s[0] < m.end() and m.start() < s[2] for s in spans):
                continue
            core = regex.search(r"[\p{L}\p{N}](.*[\p{L}\p{N}])?", m.group())
            start, end = m.start() + core.start(), m.start() + core.end()
            if end - start >= 6 and len(re.findall("[0-9@]", core.group())) >= 2:
                own = around(text, start, end)
                tokens.append((doc_id, start, end, own))
                edges.update((c, core.group()) for c in own)
    good: dict = {}
    for generation in range(1, 100):
        def sure(v: str) -> float:
            return 1 if v in known else 1 - math.prod(1 - good[c][0] for c, w in edges if w == v and c in good)
        new = {}
        for c in {c for c, _ in edges} - set(good):
            own = [(n, sure(v)) for (d, v), n in edges.items() if d == c]
            score = min(1, sum(n * s for n, s in own) / times[c.strip(" ")])
            if score >= confidence and sum(s >= confidence for _, s in own) >= support:
                new[c] = (score, generation)
        if not new:
            break
        good |= new
    added: dict = {}
    for doc_id, start, end, own in tokens:
        if own & set(good):
            added.setdefault(doc_id, []).append((start, 4, end))
    return good, added


def test_contexts_of_several_generations(spark):
    rnd = random.Random(11)
    words = "river stone walk under bright sky winter friend house tree".split()
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    code = lambda a, i: f"{a}-{7000 + i}"
    texts = [f"{prose(5)} contact: user{i}@mail.example.com {prose(4)}" for i in range(60)]
    texts += [f"{prose(5)} contact: <{code('U', i)}>, {prose(4)}" for i in range(6)]         # learnt behind contact:
    texts += [f"{prose(3)} ref: {code('U', i)}\n{prose(4)}" for i in range(6)]               # which teach ref:
    texts += [f"{prose(3)} ref: {code('V', i)} {prose(4)}" for i in range(1)]
    texts += [f"{prose(3)} my number is {code('V', 0)} {prose(2)}"] * 2
    texts += [f"{prose(3)} my number is {code('U', i)} {prose(2)}" for i in range(6)]        # "is" alone is no context
    texts += [f"{prose(3)} my number is {code('W', i)} {prose(2)}" for i in range(1)]
    texts += [f"the sky is {w} and is {w}" for w in words]
    texts += [f"{prose(2)} {code('U', i)} (account) {prose(2)}" for i in range(5)] + [f"{code('X', 1)} (account)"]   # right context
    texts += [f"under user{i}@mail.example.com and under {code('Z', i)} sky" for i in range(5)]
    texts += [f"mail:user{i}@mail.example.com glued:{code('Y', i)}" for i in range(8)]
    texts += ["", "_ _ 123456 _", f"{code('U', 1)} {code('U', 2)} {code('U', 3)}"]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    good, added = learnt(rows, 0.8, 3)
    assert max(g for _, g in good.values()) >= 3 and {"ref: ", "number is ", " (account)"} <= set(good) and "is " not in good
    found = personal_data.base_spans(docs)
    got = {r.context: (r.score, r.generation) for r in personal_data.good_contexts(found, docs).collect()}
    assert {c: g for c, (_, g) in got.items()} == {c: g for c, (_, g) in good.items()}
    assert all(abs(got[c][0] - good[c][0]) < 1e-5 for c in good)
    spans = {r.doc_id: r.spans for r in personal_data.span_digests(personal_data.personal_data(docs)).collect()}
    assert spans == {i: joined(sorted(base(t) + added.get(i, []))) for i, t in rows}
    first = {r.context for r in personal_data.good_contexts(found, docs, rounds=1).collect()}
    assert first == {c for c, (_, g) in good.items() if g == 1}


def test_contexts_counted_without_broadcast(spark, monkeypatch):
    rows = [(i, f"contact: user{i}@mail.example.com end") for i in range(20)] + [(50, "contact: U-123456 end"), (51, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted(map(tuple, personal_data.good_contexts(personal_data.base_spans(docs), docs).collect()))
    monkeypatch.setattr(personal_data, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, personal_data.good_contexts(personal_data.base_spans(docs), docs).collect())) == want != []


def test_personal_data_of_odd_documents(odd, none):
    rows = personal_data.span_digests(personal_data.personal_data(odd)).collect()
    assert len(rows) == odd.count() and all(r.spans == "" for r in rows)
    assert personal_data.span_digests(personal_data.personal_data(none)).collect() == []


def dice_scan(text: str | None, threshold: float) -> tuple:
    text = text or ""
    words = lambda u: regex.sub(r"[^\p{L}\p{N}]+", " ", u.lower()).strip(" ")
    pairs = lambda u: {tuple(p) for p in zip(u.split(" "), u.split(" ")[1:])}
    units = {words(u) for u in [text, *re.split(r"\n[ \t]*\n", text), *text.split("\n")]}
    hits = []
    for u in units:
        b = pairs(u)
        for name, t in licenses.TEMPLATES.items():
            a = pairs(words(t))
            if b and (d := 2 * len(a & b) / (len(a) + len(b))) >= threshold:
                hits.append((-d, name, u))
    if not hits:
        return None, 0.0, 0, ""
    first = min(hits)
    return first[1], -first[0], len({h[2] for h in hits}), ",".join(sorted({h[1] for h in hits}))


def test_licences(spark, odd, none):
    rnd = random.Random(8)
    texts = [r.text for r in odd.collect()]
    for t in licenses.TEMPLATES.values():
        texts += [t, t.upper(), f"some prose\n{t}\nmore prose", t.replace(" ", "\n"), f"x\n \n{t.replace(', ', ',' + chr(10))}\n\ny"]
        for _ in range(6):
            w = t.split(" ")
            for _ in range(rnd.randint(0, max(1, len(w) // 4))):
                w[rnd.randrange(len(w))] = rnd.choice(["the", "zebra", "license", "", "under"])
            texts.append("_".join(w) if rnd.random() < 0.2 else " ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for threshold in (0.6, 0.8, 1.0):
        got = {r.doc_id: tuple(r)[1:] for r in licenses.scan(docs, threshold=threshold).collect()}
        for i, text in enumerate(texts):
            assert got[i] == dice_scan(text, threshold), (threshold, text)
    assert licenses.scan(odd).count() == odd.count() and licenses.scan(none).collect() == []


def signatures(text: str, hashes: dict[str, int]) -> set:
    words = regex.sub(r"[^\p{L}\p{N}]+", " ", text.lower()).strip(" ").split(" ")
    content = [w for w in words if w not in spotsigs.ANCHORS]
    out, k = set(), 0
    for w in words:
        common = w in spotsigs.ANCHORS
        k += not common
        if k < len(content) and (common or hashes[w] % spotsigs.SPARSE == 0):
            out.add((w, *content[k:k + spotsigs.CHAIN]))
    return out or {tuple(words)}


def test_edited_likeness(spark, odd, none):
    rows = sorted(((1 << 63) - 1 if r.doc_id is None else r.doc_id, r.text or "") for r in odd.collect())
    hashed = odd.selectExpr("doc_id", "coalesce(doc_id, 9223372036854775807) AS place", "xxhash64(coalesce(text, '')) AS hash",
                            "coalesce(text, '') AS text").orderBy("place", "hash").collect()
    texts = [r.text for r in hashed]
    edited = [t[:len(t) - len(t) // 4] + texts[(i + 1) % len(texts)][:len(t) // 4] for i, t in enumerate(texts)]
    words = sorted({w for t in texts + edited for w in regex.sub(r"[^\p{L}\p{N}]+", " ", t.lower()).strip(" ").split(" ")})
    hashes = {r.w: r.h for r in spark.createDataFrame([(w,) for w in words], "w string").selectExpr("w", "hash(w) AS h").collect()}
    like = lambda a, b: len(a & b) / len(a | b)
    want = []
    for i, (r, e) in enumerate(zip(hashed, edited)):
        own, changed, after = (signatures(t, hashes) for t in (r.text, e, texts[(i + 1) % len(texts)]))
        want.append((r.doc_id, len(r.text), hashlib.sha256(e.encode()).hexdigest(), like(own, changed), like(own, after)))
    got = spotsigs.edited_report(spotsigs.edited_likeness(odd)).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got), key=repr) == sorted(want, key=repr)
    assert len({r.fingerprint for r in got}) == len({frozenset(signatures(t, hashes)) for _, t in rows})
    assert spotsigs.edited_report(spotsigs.edited_likeness(none)).collect() == []


def test_next_rows_over_many_stretches(spark, monkeypatch):
    monkeypatch.setattr(spotsigs, "STRETCH", 3)
    rnd = random.Random(1)
    keys = sorted((rnd.randrange(50) if rnd.random() < 0.5 else rnd.randrange(-10**12, 10**12), rnd.getrandbits(60)) for _ in range(500))
    rows = spark.createDataFrame([(*k, i) for i, k in enumerate(keys)], "place long, hash long, n long").repartition(6)
    got = {r.n: r.next_n for r in spotsigs.with_next(rows, ["n"], spotsigs.boundaries(rows)).collect()}
    assert got == {i: (i + 1) % 500 for i in range(500)}
    single = rows.filter("n = 7")
    one = spotsigs.with_next(single, ["n"], spotsigs.boundaries(single)).collect()
    assert [(r.n, r.next_n) for r in one] == [(7, 7)]


def test_near_pairs(spark, odd, none):
    rnd = random.Random(12)
    words = [f"w{i}" for i in range(60)] + spotsigs.ANCHORS[:20]
    texts = []
    for _ in range(25):
        text = [rnd.choice(words) for _ in range(rnd.randint(5, 120))]
        for _ in range(rnd.randint(1, 5)):
            texts.append(" ".join(text))
            text = [w if rnd.random() > 0.02 else rnd.choice(words) for w in text]
    hashes = {r.w: r.h for r in spark.createDataFrame([(w,) for w in words], "w string").selectExpr("w", "hash(w) AS h").collect()}
    sets = [signatures(t, hashes) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for threshold in (0.5, 0.8, 1.0):
        members, pairs = spotsigs.near_pairs(docs, threshold)
        first = {i: min(j for j, s in enumerate(sets) if s == sets[i]) for i in range(len(sets))}
        assert {r.doc_id: r.class_id for r in members.collect()} == first
        reps = sorted(set(first.values()))
        want = {(a, b) for a in reps for b in reps if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold}
        assert {tuple(sorted((r.a, r.b))) for r in pairs.collect()} == want
    members, pairs = spotsigs.near_pairs(odd)
    assert members.count() == odd.count() and spotsigs.near_pairs(none)[1].count() == 0
