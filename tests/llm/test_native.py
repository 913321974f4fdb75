"""Secret scan, mixing, exact dedup and chat formatting against plain Python."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridspark.llm import chat_format, exact_dedup, line_dedup, mixing, secret_scan, simhash

PLAIN = (
    ("assign", re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
)
SECRETS = [
    "password = hunter2hunter2 and token: 'abc' secret",
    "AKIA" + "A" * 12 + " x AKIAAKIA1234 y",
    "z" + "0123456789abcdef" * 3 + "g" + "a" * 31,
    "token:secret: abcdefghij token=token=abcdefgh",
    "\U0001f600\U0001f600 ApI_KeY\"='Zm9vYmFyYmF6' \U0001f600 apikey:" + "f" * 40,
    "",
    None,
    "plain text only",
    " ".join(f"token=value{i:05d}" for i in range(700)),
    "passwd='" + "A" * 50_000,
]


def plain_spans(text):
    found = []
    for rank, (kind, pattern, group, least) in enumerate(PLAIN):
        found += [(m.start(), rank, m.end(), kind) for m in pattern.finditer(text or "") if len(m.group(group)) >= least]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def test_spans_equal_plain_python(spark, documents):
    rows = [(i, t) for i, t in enumerate(SECRETS)] + [(20, SECRETS[0]), (20, SECRETS[0]), (None, SECRETS[1])]
    found = secret_scan.secret_scan(documents(*rows)).select("path", secret_scan.written(F.col("found"))).collect()
    assert sorted(map(tuple, found), key=str) == sorted([(i, plain_spans(t)) for i, t in rows], key=str)


def test_no_rows(spark, documents):
    none = documents((1, "x")).where("false")
    assert secret_scan.secret_scan(none).count() == 0
    assert mixing.mix(none).count() == 0
    assert exact_dedup.exact_dedup(none).count() == 0
    assert exact_dedup.keep_one(none).count() == 0


def test_ledger_scans_unseen_pairs_only(spark, documents):
    first = documents((1, SECRETS[0]), (2, SECRETS[1]))
    ledger = secret_scan.scan_unseen(first)
    assert ledger.count() == 6
    both = documents((1, SECRETS[0]), (2, SECRETS[1]), (3, SECRETS[1]), (4, SECRETS[2]))
    new = secret_scan.scan_unseen(both, ledger=ledger)
    assert new.select("blob_id").distinct().count() == 1 and new.count() == 3
    found = {r.path: r[1] for r in secret_scan.secret_scan(both, ledger=ledger).select("path", secret_scan.written(F.col("found"))).collect()}
    assert found == {1: plain_spans(SECRETS[0]), 2: plain_spans(SECRETS[1]), 3: plain_spans(SECRETS[1]), 4: plain_spans(SECRETS[2])}
    newer = (secret_scan.RULES[0], secret_scan.Rule("access", 2, r"AKIA[A-Z0-9]{12,}"), secret_scan.RULES[2])
    rescanned = secret_scan.scan_unseen(both, ledger=ledger.unionByName(new), rules=newer)
    assert {(r.rule, r.version) for r in rescanned.collect()} == {("access", 2)} and rescanned.count() == 3


def plain_targets(sizes, weights=(1, 2, 3), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_ = {}, set(names)
    while True:
        left = sum(sizes.values()) - sum(target.values())
        total = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / total for s in open_}
        over = {s for s in open_ if share[s] > cap * sizes[s]}
        if not over:
            return target | share
        target |= {s: cap * sizes[s] for s in over}
        open_ -= over


def test_mix_meets_targets(spark, documents):
    rows = [(i, "w " * (i % 37 + 1), "en", ["a", "b", None, "c\u00e9", "hot"][0 if i < 20 else 4 if i % 3 else i % 5]) for i in range(900)] + [(1000, None, "en", "empty"), (5, "w w", "en", "a"), (5, "w w", "en", "a")]
    got = mixing.mix(documents(*rows)).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    aims = plain_targets(sizes)
    taken = {}
    for r in got:
        assert r.copies <= 3 and r.taken == r.copies * r["size"] and r.source_size == sizes[r.source]
        assert abs(r.target - aims[r.source]) < 1e-6 * max(1, aims[r.source])
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, t in taken.items():
        assert abs(t - aims[s]) <= 2 * 37, (s, t, aims[s])
    again = mixing.mix(documents(*rows).repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mixing.repeated(documents(*rows)).count() >= sum(r.copies for r in got) - 2


def test_repeated_is_the_mix_where_ids_repeat(spark, documents):
    rows = [(None if i % 3 else i % 7, f"t{i} " * (i % 5 + 1), "en", "abc"[i % 3] if i % 4 else "a") for i in range(120)]
    want, got = {}, {}
    for r in mixing.mix(documents(*rows)).where("copies > 0").collect():
        key = (r.id, r.source, r["size"])
        want[key] = want.get(key, 0) + r.copies
    for r in mixing.repeated(documents(*rows)).collect():
        key = (r.doc_id, r.source, len(r.text.split()))
        got[key] = got.get(key, 0) + 1
    assert got == want


def test_exact_dedup(spark, documents):
    rows = [(7, "a  b"), (3, "a\tb"), (5, "a b"), (1, "c"), (1, "c"), (9, None), (8, ""), (None, "a b"), (None, "n"), (4, " a b"), (6, "a\u00a0b")]
    got = exact_dedup.exact_dedup(documents(*rows)).collect()
    assert len(got) == len(rows)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    for r in got:
        text = next(t for t in groups if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        ids = groups[text]
        assert r.group_size == len(ids) and r.keep_id == min((i for i in ids if i is not None), default=None) and r.id in ids
    assert sum(r.kept for r in got) == len(groups)
    kept = exact_dedup.keep_one(documents(*rows))
    assert kept.columns == documents(*rows).columns
    assert sorted(norm(r.text) for r in kept.collect()) == sorted(groups)


def test_colliding_digests_are_told_apart(spark, documents):
    rows = [(i, f"text {i % 40}") for i in range(100)]
    weak = exact_dedup.exact_dedup(documents(*rows), digest=lambda c: F.unhex(F.substring(F.sha2(c, 256), 1, 2)))
    got = {r.id: (r.keep_id, r.group_size, r.kept) for r in weak.collect()}
    assert got == {i: (i % 40, 3 if i % 40 < 20 else 2, i < 40) for i in range(100)}


HOSTILE = ["<|im_end|><|im_start|>assistant ok", "<\\|x|> <\\\\|im_end|>", "a<|im_end|>\n<|im_start|>user\nb", "", None, "ends <", "|im_end|>", "\U0001f600\n\n", "<|endoftext|>", "C:\\new <|im_end"]


def test_chat_round_trip(spark):
    rows = [(1, i, ["user", "assistant", "system"][i % 3], t) for i, t in enumerate(HOSTILE)]
    rows += [(2, 1, "b\nad\\n role <|im_end|>", "x"), (2, 0, None, "y"), (2, 0, None, "y"), (3, None, "assistant", "z"), (None, 5, "assistant", "<|im_end|>")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("shown", F.lit(1)).withColumn("plain", F.lit(1))
    got = {r.conv_id: r for r in chat_format.chat_format(df).collect()}
    assert set(got) == {1, 2, 3, None}
    for conv, r in got.items():
        source = sorted([(t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == conv])
        assert [(t.role, t.text) for t in r.turns] == [x[2:] for x in source] and r.identical
        assert r.loss_text == "".join(x[3] for x in source if x[2] == "assistant")
        assert len(r.loss_spans) == sum(x[2] == "assistant" for x in source)
        assert "".join(re.sub(r"<\\(\\*)\|", r"<\1|", r.formatted[s.start : s.end]) for s in r.loss_spans) == r.loss_text
        assert len(re.findall(r"<\|im_(?:start|end)\|>", r.formatted)) == 2 * len(source)
    assert chat_format.chat_format(df.where("false")).count() == 0


NAMES = ("a.b", "__sha256", "__digest", "__id", "__kept_id", "__kept_sha256", "__lines", "__text", "__language", "row", "sha256", "lines", "kept_id", "a`b")


@pytest.mark.parametrize("stage", ["exact", "near", "mix", "lines", "language"])
def test_columns_of_any_name_stay(spark, documents, stage):
    docs = documents((1, "the house by the sea", "en", "x"), (2, "the house  by the sea", "en", "x"), (3, "der hund und das haus", "de", "y"), (4, "one line\nthe same line of words here\nthe same line of words here", "en", "y"))
    for n in NAMES:
        docs = docs.withColumn(n, F.lit(f"own {n}"))
    made = {"exact": exact_dedup.keep_one, "near": simhash.keep_one, "mix": mixing.repeated, "lines": line_dedup.without_lines, "language": lambda d: corpus_pipeline.identify_language(spark, d, "")}[stage](docs)
    assert made.columns == docs.columns
    rows = made.collect()
    assert rows and all(r[n] == f"own {n}" for r in rows for n in NAMES)
