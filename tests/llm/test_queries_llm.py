"""The registered queries on small tables, against plain Python over the same rows."""

from __future__ import annotations

import base64
import hashlib
import os
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from reviewlens.llm.queries import ENTRIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def rows(spark, name):
    return spark.read.parquet(f"{FOLDER}/{name}.parquet").collect()


def run(spark, name):
    return ENTRIES[name].run(spark, FOLDER).collect()


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def fold(id) -> int:
    return zlib.crc32(str(id).encode()) % 4


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in rows(spark, "documents")}


def test_bpe_as_the_public_library(spark, docs):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = run(spark, "op1_byte_bpe")
    assert len(got) == len(docs)
    for r in got:
        text = docs[r["doc_id"]]["text"]
        ids = plain.encode_ordinary(text)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids)).encode()), sha(text.encode()))


def groups(links, ids):
    least = {i: i for i in ids}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        least[b] = a
    return {i: root(i) for i in ids}


def shingled(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} - {()}


def test_jaccard_join_as_brute_force(spark, docs):
    sets = {i: shingled(r["text"], 3) for i, r in docs.items()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    want = groups(links, sets)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in run(spark, "op2_ngram_jaccard_join")} == {i: (len(s), want[i]) for i, s in sets.items()}


def test_vectors_as_brute_force(spark):
    data = rows(spark, "embeddings")
    ids = np.array([r["vec_id"] for r in data])
    labels = np.array([r["label"] for r in data])
    x = np.array([r["embedding"] for r in data], np.float64)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    near = (x @ x.T >= 0.93) & (labels[:, None] == labels) & ~np.eye(len(x), dtype=bool)
    want = groups([(ids[i], ids[j]) for i, j in np.argwhere(near)], ids.tolist())
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in run(spark, "op3_embedding_near_dedup")}
    assert got == {i: (int(n), want[i], want[i] == i) for i, n in zip(ids.tolist(), near.sum(1), strict=True)}


def test_language_of_held_out_documents(spark, docs):
    got = run(spark, "op4_language_id")
    assert len(got) == len(docs) and all(r["held_out"] == (fold(r["doc_id"]) == 2) and 0 <= r["score"] <= 1 for r in got)
    held = [r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in got if r["held_out"]]
    assert sum(held) >= 0.95 * len(held)


def test_quality_of_held_out_documents(spark, docs):
    truth = {r["doc_id"]: r["quality"] for r in rows(spark, "labels")}
    got = run(spark, "op5_quality_classifier")
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    held = [r["predicted"] == truth[r["doc_id"]] for r in got if r["held_out"] and r["doc_id"] in truth]
    assert sum(held) >= 0.85 * len(held)


def listed(found, kinds):
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted((s, kinds.index(k), k, e) for k, s, e in found))


def test_secrets_hold_the_base_spans(spark, docs):
    kinds = ("assign", "access", "hex")
    for r in run(spark, "op6_secret_scan"):
        text = docs[r["doc_id"]]["text"]
        found = [("assign", *m.span()) for m in re.finditer(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
        found += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        found += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
        assert r["base_sha256"] == sha(listed(found, kinds).encode())
        assert set(filter(None, listed(found, kinds).split(","))) <= set(r["spans"].split(","))
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == f[0] for f in found) for k in kinds]


def test_benchmark_items_are_found(spark, docs):
    plain = {i: " ".join(r["text"].lower().split()) for i, r in docs.items()}
    items = {r["item_id"]: " ".join(r["text"].lower().split()) for r in rows(spark, "benchmark")}
    want = {(d, i) for d, t in plain.items() for i, s in items.items() if s in t}
    got = {(r["doc_id"], r["item_id"]): r["n_errors"] for r in run(spark, "op7_benchmark_decontamination")}
    assert want and {k for k, n in got.items() if n == 0} == want


def test_personal_data_holds_the_base_spans(spark, docs):
    kinds = ("email", "ip", "card", "phone")

    def right(digits):
        return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0

    for r in run(spark, "op10_personal_data"):
        text = docs[r["doc_id"]]["text"]
        digits = lambda s: re.sub("[^0-9]", "", s)
        found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
        found += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m[0])) <= 19 and right(digits(m[0]))]
        found += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m[0])) <= 15]
        assert r["base_sha256"] == sha(listed(found, kinds).encode())
        assert set(filter(None, listed(found, kinds).split(","))) <= set(r["spans"].split(","))
        assert [r[f"n_{k}"] for k in kinds] == [sum(k == f[0] for f in found) for k in kinds]
