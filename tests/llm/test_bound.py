"""Every column that a query owes, on a folder of small hostile tables, against plain Python."""

import hashlib
import zlib
from collections import Counter

import pytest

from gridspark.llm import queries
from tests.llm.test_alignment import COLUMNS, plain
from tests.llm.test_jaccard import plain as plain_join
from tests.llm.test_lines import plain_removed
from tests.llm.test_models import library, plain_components, plain_fingerprint
from tests.llm.test_native import plain_spans


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Null ids and texts, copies, near copies, repeated rows, texts that are empty or long, further columns."""
    base, path = "/root/testdata/sf0.001", tmp_path_factory.mktemp("bound")
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{base}/documents.parquet").where("doc_id < 90").collect()]
    rows += [(9000 + i, t, "en", None) for i, (_, t, _, _) in enumerate(rows[:8])] + [(9100 + i, f"{t} ends", "en", "src1") for i, (_, t, _, _) in enumerate(rows[:8])]
    rows += [(9200, None, "en", "x"), (9201, "", None, "x"), (9202, " \n\t", "de", "x"), (None, rows[1][1], "en", "x"), (None, "token: abcdefgh12345", "en", "x"), rows[5], rows[5]]
    rows += [(9300, "one line\n" * 400 + "token=0123456789abcdef0123456789abcdef", "en", "x"), (9301, "x" * 30_000, "en", "x")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "'y' AS n", "'y' AS row", "'y' AS key").coalesce(3).write.parquet(f"{path}/documents.parquet")
    for name in ("labels", "embeddings"):
        spark.read.parquet(f"{base}/{name}.parquet").coalesce(2).write.parquet(f"{path}/{name}.parquet")
    return str(path), rows


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def secrets(rows):
    found = [(i, plain_spans(t)) for i, t in rows]
    count = lambda spans, kind: sum(x.startswith(kind) for x in spans.split(","))
    return [(i, count(s, "assign"), count(s, "access"), count(s, "hex"), sha(s), s) for i, s in found]


def tokens(rows):
    enc = library()
    ids = [(i, t or "", enc.encode_ordinary(t or "")) for i, t in rows]
    return [(i, len(x), sha(" ".join(map(str, x))), sha(t)) for i, t, x in ids]


def lines(rows):
    removed = plain_removed(list(dict.fromkeys(rows)))  # repeated rows share their lines
    out = []
    for i, t in rows:
        gone = sorted(removed.get(i, ())) if i is not None else []
        out.append((i, len((t or "").split("\n")), len(gone), ",".join(map(str, gone))))
    return out


def near(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    label, low = plain_components(fps), {}
    for (i, _), k in zip(rows, label, strict=True):
        low[k] = i if low.get(k) is None else low[k] if i is None else min(i, low[k])
    return [(i, f"{f:016x}", low[k]) for (i, _), f, k in zip(rows, fps, label, strict=True)]


CASES = {
    "op1_secret_scan": ("doc_id n_assign n_access n_hex base_sha256 spans", secrets),
    "op3_byte_bpe": ("doc_id n_tokens ids_sha256 decoded_sha256", tokens),
    "op5_line_dedup": ("doc_id n_lines n_removed removed_lines", lines),
    "op9_simhash": ("doc_id fingerprint component_id", near),
    "op12_jaccard_join": ("doc_id n_shingles component_id", lambda rows: list(plain_join(rows).elements())),
    "op13_token_alignment": ("doc_id " + " ".join(COLUMNS), lambda rows: [(i, *p) for (i, _), p in zip(rows, plain([t for _, t in rows]), strict=True)]),
}


@pytest.mark.parametrize("name", CASES)
def test_query_equals_brute_force(spark, folder, name):
    path, rows = folder
    columns, made = CASES[name]
    got = Counter(map(tuple, queries.QUERIES[name](spark, path).select(*columns.split()).collect()))
    assert got == Counter(made([(i, t) for i, t, _, _ in rows]))


@pytest.mark.parametrize(("name", "parts", "part"), [("op7_language_id", 4, 2), ("op10_toxicity", 5, 0)])
def test_models_keep_their_contract(spark, folder, name, parts, part):
    path, rows = folder
    got = queries.QUERIES[name](spark, path).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, *_ in rows)
    learned, text = {x for i, _, x, _ in rows if x and (i is None or zlib.crc32(str(i).encode()) % 4 != 2)}, {i: t for i, t, _, _ in rows}
    for r in got:
        assert r.held_out == ((zlib.crc32(str(r.doc_id).encode()) if r.doc_id is not None else 0) % parts == part) and 0 <= r.score <= 1
        if name == "op10_toxicity":
            assert r.predicted == int(r.score >= 0.5)
        else:
            assert r.lang_pred in (learned if any(c.isalpha() for c in text[r.doc_id] or "") else {"und"})
