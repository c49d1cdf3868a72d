"""What the second review found missing: each case fails on the code before it."""

import random
import string
from collections import Counter

import pytest
from brute import components, shingle_set
from test_operators import lookalikes, table

import corpus_pipeline
from quillmesh.llm import jaccard_tree, secrets

SF = "/root/testdata/sf0.001"


def test_pipeline_joins_copies_on_five_words(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    label = components([(r["doc_id"], r["text"]) for r in docs.collect()], percent=80, size=5)
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, SF)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, v in label.items() if v[1] == i}


@pytest.mark.parametrize("leaf", [8, 256])
def test_join_finds_every_link(spark, monkeypatch, leaf):
    """Families of mutually linked edited copies: all their pairs, not only those that connect them."""
    monkeypatch.setattr(jaccard_tree, "LEAF", leaf)
    monkeypatch.setattr(jaccard_tree, "SET_LEAF", leaf)
    texts = lookalikes(11, 3, (25, 35), (100, 140), (0, 3))
    docs = [*texts, (900, texts[0][1]), (901, ""), (902, None), (None, "no id here")]
    classes = {}
    for i, text in docs:
        if i is not None and (s := frozenset(shingle_set(text))):
            classes.setdefault(s, []).append(i)
    order = [(min(ids), s) for s, ids in classes.items()]
    wanted = {
        (min(a, b), max(a, b))
        for k, (a, s) in enumerate(order)
        for b, t in order[k + 1 :]
        if 100 * len(s & t) >= 90 * len(s | t)
    }
    pairs, members = jaccard_tree.links(table(spark, docs))
    found = [(r["a"], r["b"]) for r in pairs.collect()]
    assert len(found) == len(set(found)) and set(found) == wanted and len(wanted) > len(order)
    class_of = {i: min(ids) for ids in classes.values() for i in ids} | {901: 901, 902: 902, None: None}
    assert sorted(((r["doc_id"], r["class_id"]) for r in members.collect()), key=repr) == sorted(class_of.items(), key=repr)
    degree = Counter(x for pair in wanted for x in pair)
    counts = jaccard_tree.link_counts(table(spark, docs)).collect()
    assert len(counts) == len(docs)
    assert {r["doc_id"]: r["n_links"] for r in counts} == {i: None if i is None else degree[c] for i, c in class_of.items()}


def pem(seed, kind="RSA ", footer=True):
    rng = random.Random(seed)
    lines = ["".join(rng.choice(string.ascii_letters + string.digits + "+/") for _ in range(64)) for _ in range(4)]
    body = f"-----BEGIN {kind}PRIVATE KEY-----\n" + "\n".join(lines)
    return body + f"\n-----END {kind}PRIVATE KEY-----" if footer else body


def test_private_keys_are_owned_by_their_bodies(spark):
    """Nine keys of nine sources under the same header stay live; one key of nine sources does not."""
    armoured = pem(99, "").replace("KEY-----\n", "KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0F\n\n", 1)
    own = [pem(k) for k in range(9)] + [pem(50, footer=False), armoured]
    shared = pem(77)
    rows = [(k, f"mine {x} end", f"s{k}") for k, x in enumerate(own)]
    rows += [(100 + k, f"see {shared if k % 2 else shared.replace(chr(10), chr(13) + chr(10))} {k}", f"s{k}") for k in range(9)]
    rows += [(200, "a header -----BEGIN RSA PRIVATE KEY----- alone is no key", "s0")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)
    texts = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    assert all(texts[k] == "mine [REDACTED] end" for k in range(len(own)))
    assert all(texts[i] == text for i, text, _ in rows if i >= 100)
    live = {r["doc_id"]: r["n_live"] for r in secrets.scan(docs).collect()}
    assert all(live[k] >= 1 for k in range(len(own))) and live[200] == 0


def test_repositories_and_short_passwords_count(spark):
    """An example in many texts of one source stays; copies of one text do not make an example; short passwords go."""
    example, copied = "token=aB3dE6gH9jK2", "token=zY8xW5vU2tS9"
    rows = [(k, f"text {k} with {example} inside", "hot") for k in range(40)]
    rows += [(100 + k, f"the same text with {copied} inside", "hot") for k in range(40)]
    rows += [(200, "password=hunt3r2 x", "a"), (201, "password=letter x", "a"), (202, "password=a1a1a1a1 x", "a")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)
    texts = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    assert all(texts[k] == rows[k][1] for k in range(40))
    assert all(texts[100 + k] == "the same text with [REDACTED] inside" for k in range(40))
    assert (texts[200], texts[201], texts[202]) == ("[REDACTED] x", "password=letter x", "password=a1a1a1a1 x")
    counts = {r["doc_id"]: (r["n_live"], r["n_copied"]) for r in secrets.scan(docs).collect()}
    assert (counts[0], counts[100], counts[200], counts[201]) == ((0, 1), (1, 0), (1, 0), (0, 0))
    held = secrets.judged(secrets.candidates(docs)[1]).filter("doc_id in (0, 100)").collect()
    assert {r["doc_id"]: (r["n_owners"], r["n_repositories"]) for r in held} == {0: (1, 40), 100: (1, 1)}
