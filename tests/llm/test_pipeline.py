"""The pipeline's stages against a plain Python version, each on its own input."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from echogrid.llm import jaccard, packing, quality, secrets
from echogrid.llm.common import stage
from test_operators import DOCS, SF, WORD, base_spans, brute_components, brute_fingerprint, check_packed, odd_documents


def line_fails(line):
    n = len(WORD.findall(line))
    count = lambda chars: sum(line.count(c) for c in chars)
    shouts = 2 * line.count("!!")
    return n > 0 and (
        (count(quality.SEPARATORS) >= 3 and count(quality.SEPARATORS) * 5 >= n)
        or count(quality.SYMBOLS) > n
        or (shouts >= n and shouts >= 4)
        or (n >= 8 and not re.search(quality.SENTENCE_MARK, line))
        or (n <= 25 and re.search(quality.BOILERPLATE, line.lower()) is not None)
    )


def cleaned(text):
    """The cleaned text, or None for a document that is rejected."""
    w = WORD.findall(text)
    windows = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    covered = {k + j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    lost = sum(len(x) for x in lines if line_fails(x))
    if len(w) < 10 or 100 * len(covered) > 20 * len(w) or 100 * lost > quality.MAX_LOST_PERCENT * sum(map(len, lines)):
        return None
    return "\n".join(x for x in text.split("\n") if not line_fails(x))


def candidate_spans(t):
    base = base_spans(t)
    out = [(a, k, kind, b, secrets_value(t[a:b], kind)) for a, k, kind, b in base]
    for m in re.finditer(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}(?![A-Za-z0-9_-])", t):
        v = m[0]
        mixed = (re.search("[A-Z]", v) and re.search("[a-z]", v)) or len(re.findall("[0-9]", v)) >= 4
        if looks_live(v) and mixed and not any(a < m.end() and m.start() < b for a, _, _, b, _ in out):
            out.append((m.start(), 3, "owned", m.end(), v))
    return sorted(out)


def secrets_value(whole, kind):
    return re.search(r"""[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$""", whole)[1] if kind == "assign" else whole


def looks_live(v):
    return bool(re.search("[0-9]", v) and re.search("[A-Za-z]", v)) and len(set(v)) >= 8 and not re.search("example|changeme|placeholder|xxxx|1234567", v.lower())


def redacted(docs):
    """doc_id, text of each document with live secrets replaced."""
    owners, repositories, spans = defaultdict(set), defaultdict(set), {}
    for i, (t, s) in docs.items():
        spans[i] = candidate_spans(t)
        for *_, v in spans[i]:
            owners[v].add(s)
            repositories[v].add(i)
    copied = lambda v: len(owners[v]) >= secrets.EXAMPLE_OWNERS or (len(owners[v]) > 1 and len(repositories[v]) >= secrets.EXAMPLE_REPOSITORIES)
    out = {}
    for i, (t, _) in docs.items():
        at, parts = 0, []
        for a, _, kind, b, v in spans[i]:
            if looks_live(v) and not copied(v) and b > at:
                parts += [t[at : max(a, at)], f"[SECRET:{kind}]"]
                at = b
        out[i] = "".join(parts) + t[at:]
    return out


def test_stages(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_dedup", "secret_scan", "source_mixing", "best_fit_packing"] and corpus_pipeline.ORACLE_SQL is None
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tables = [docs]
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        tables.append(stage(f(spark, tables[-1], SF)))
        assert k == 4 or tables[-1].columns == docs.columns
    rows = [{r.doc_id: r for r in t.collect()} for t in tables[:4]]
    want = {i: c for i, r in rows[0].items() if (c := cleaned(r.text or "")) is not None}
    assert {i: r.text for i, r in rows[1].items()} == want and all(r.n_chars == len(r.text) for r in rows[1].values())
    comp = brute_near({i: r.text for i, r in rows[1].items()})
    assert set(rows[2]) == set(comp.values()) and all(rows[2][i] == rows[1][i] for i in rows[2])
    assert {i: r.text for i, r in rows[3].items()} == redacted({i: (r.text, r.source) for i, r in rows[2].items()})
    mixed = tables[4].collect()
    size = {i: len(WORD.findall(r.text)) for i, r in rows[3].items()}
    assert all(rows[3][r.doc_id] == r for r in mixed) and max(Counter(r.doc_id for r in mixed).values()) <= 2
    assert math.isclose(sum(size[r.doc_id] for r in mixed), 1.5 * sum(size.values()), rel_tol=0.15)
    packed = tables[5].collect()
    copies = Counter(r.doc_id for r in mixed)
    once = [r for r in packed if copies[r.doc_id] == 1]
    assert sum(r.length for r in packed) == sum(len(packing.token_ids(r.text)) for r in mixed)
    check_packed_copies(packed, copies, {i: rows[3][i].text for i in copies})
    assert once


def shingle_set(text):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = WORD.findall(w)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 5 else {tuple(w)}


def brute_near(texts):
    """The smallest id of each text's group, by all pairs."""
    sets, least = {i: shingle_set(t) for i, t in texts.items()}, {i: i for i in texts}
    ids, near = sorted(sets), defaultdict(set)
    for i in ids:
        for j in ids:
            both = len(sets[i] & sets[j])
            if i < j and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                near[i].add(j)
                near[j].add(i)
    for i in ids:  # by rising id, so the first to reach a text is the least
        todo = [i] if least[i] == i else []
        while todo:
            for k in near[todo.pop()]:
                if least[k] > i:
                    least[k] = i
                    todo.append(k)
    return least


@pytest.mark.parametrize("common, shard, big, many", [(4, 10**6, 64, 16), (2, 500, 64, 0), (2, 10**6, 1, 16), (16, 500, 0, 0)])
def test_near_dedup_is_exact(spark, monkeypatch, common, shard, big, many):
    monkeypatch.setattr(jaccard, "BIG", big)
    monkeypatch.setattr(jaccard, "BLOCK", 3 if big < 64 else 1024)
    monkeypatch.setattr(jaccard, "MANY_PAIRS", many)
    monkeypatch.setattr(jaccard, "COMMON", common)
    monkeypatch.setattr(jaccard, "SHARD_ENTRIES", shard)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rng = random.Random(4)
    words = [f"w{k}" for k in range(400)]
    for g in range(12):  # chains of changes: neighbours are near, the ends are not
        w = rng.choices(words, k=rng.choice([12, 60, 200]))
        for k in range(8):
            texts[10_000 + 10 * g + k] = " ".join(w).upper() if k == 3 else "  ".join(w)
            w = list(w)
            for _ in range(max(1, len(w) // 60)):
                w[rng.randrange(len(w))] = rng.choice(words)
    want = brute_near(texts)
    bits = {i: brute_fingerprint(t) for i, t in texts.items()}
    assert any(i != j and (bits[i] ^ bits[j]).bit_count() > 4 for i, j in want.items())  # beyond op5's radius
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in texts.items()], DOCS)
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()}
    assert kept == set(want.values())
    assert dict(jaccard.near_duplicates(docs).collect()) == want


def test_near_dedup_goes_by_fingerprints(spark, monkeypatch):
    """Links of fingerprints are found and verified also where the join has no candidates to offer."""
    from pyspark.sql import functions as F

    texts = {1: "a b c d e f g h", 2: "A B C D E F G H", 3: "a b c d e f g h", 4: "q r s t u v w x y", 5: None, 6: " "}
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in texts.items()], DOCS)
    monkeypatch.setattr(jaccard, "_candidates", lambda pairs: stage(pairs.select("a", "b").limit(0)))
    monkeypatch.setattr(jaccard, "_possible", lambda a, b: F.lit(False))
    assert dict(jaccard.near_duplicates(docs).collect()) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5}
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()} == {1, 4, 5}


def check_packed_copies(rows, copies, texts):
    """Every copy has all its pieces; sequences have no gaps."""
    pieces = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert all(n == copies[k[0]] for k, n in pieces.items())
    one = [r for r in {(r.doc_id, r.piece): r for r in rows}.values()]
    assert {r.doc_id for r in one} == set(texts)
    by_seq = defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append((r.offset, r.length))
    for s in by_seq.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024


def test_run_and_odd_rows(spark):
    first = sorted(map(str, corpus_pipeline.run(spark, SF).collect()))
    assert first == sorted(map(str, corpus_pipeline.run(spark, SF).collect()))
    names = [f.split()[0] for f in DOCS.split(", ")]
    odd = odd_documents(spark).select(*names)
    for table in (odd, odd.limit(0)):
        docs = table
        for k, (_, f) in enumerate(corpus_pipeline.STAGES):
            docs = stage(f(spark, docs, SF))
            assert k == 4 or docs.columns == names


def test_packed_table_is_checked():
    assert check_packed([], {}, 4) == 0
