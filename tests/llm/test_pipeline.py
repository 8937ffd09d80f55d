"""The pipeline against a plain version in Python, stage by stage."""

import hashlib

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import byte_bpe, decontaminate, pseudonyms, quality
from quern.llm.common import held_out, table
from quern.llm.queries import SAMPLE_KEY

from ..conftest import SF
from .helpers import empty, odd
from .test_pairs import brute


def test_as_plain_version(spark):
    documents, labels = table(spark, SF, "documents"), table(spark, SF, "labels").where(~held_out("doc_id", 5, 0))
    rules = quality.learn(documents, labels)
    told = documents.select("doc_id", *[c.alias(n) for n, c in quality.statistics(F.col("text")).items()]).collect()
    good = {r.doc_id for r in told if 1 / (1 + 2.718281828459045 ** -(rules.bias + sum(w for w, bounds in rules.rules if all((r[n] > k) == above for n, above, k in bounds)))) >= 0.3}
    texts = {r.doc_id: r.text for r in documents.collect() if r.doc_id in good}
    components, _ = brute(texts, 5, 8, 10)
    texts = {i: t for i, t in texts.items() if components[i] == i}
    windows = set()
    for item in table(spark, SF, "benchmark").collect():
        words = decontaminate.words_of(item.text)
        windows |= {tuple(words[i : i + 13]) for i in range(max(1, len(words) - 12) if words else 0)}
    sizes = {len(w) for w in windows}

    def contaminated(text):
        words, hit = decontaminate.words_of(text), set()
        for n in sizes:
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) in windows:
                    hit.update(range(i, i + n))
        return bool(hit) and 20 * len(hit) >= len(words)

    texts = {i: pseudonyms.pseudonymised(t, SAMPLE_KEY)[0] for i, t in texts.items() if not contaminated(t)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    found = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(found) == set(texts) and len(texts) < documents.count()
    for i, r in found.items():
        assert r.ids == library.encode_ordinary(texts[i]) and r.decoded_sha256 == hashlib.sha256(texts[i].encode()).hexdigest()


def test_stages_take_odd_rows(spark):
    for docs in (odd(spark), empty(spark)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns and out.count() <= docs.count()
