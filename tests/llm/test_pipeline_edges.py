"""Pipeline stages on clashing columns, empty tables, nulls and repeats; the shared folder."""

import collections

import pytest

import corpus_pipeline
from cloakline.llm import common, mixing, suffix_dedup
from cloakline.llm import sentencepiece_dropout as sp
from test_operators import words

CLASHES = (
    "pass at ids copy q_words kept lossless q_kept q_lang n_removed n_bytes key code _p0 _p1 _c0 _at _row _id size taken target sid slot block word words "
    "n_pieces ids_crc32 docs_ids component_id node root first starts a.b"
).split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)


def row(i, text, lang="en", source="s"):
    return (i, text, lang, source, len(text or ""), *[f"{c}{i}" for c in CLASHES])


@pytest.fixture(scope="module")
def docs(spark):
    rows = [row(i, words(40 + i % 9, i), "en", f"s{i % 3}") for i in range(30)]
    return spark.createDataFrame([*rows, rows[3], row(40, words(45, 3) + " " + words(3, 99)), row(None, words(50, 77), None, None)], SCHEMA).repartition(3)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_carry_columns_of_any_name(spark, docs, name, stage):
    got = stage(spark, docs, "")
    if name == "pieces":
        assert got.columns[2:5] == ["lang", "source", "n_chars"] and {"docs_ids", "docs_docs_ids", "docs_lossless"} <= set(got.columns)
    else:
        assert got.columns == docs.columns and got.schema == docs.schema or [f.dataType for f in got.schema] == [f.dataType for f in docs.schema]
    for r in got.collect():
        if r.doc_id is not None:
            for i, c in enumerate(CLASHES):
                at = docs.columns.index(c) if name != "pieces" else 5 + i
                assert r[at] == f"{c}{r.doc_id}", (name, c)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_empty_tables(spark, docs, name, stage):
    none = docs.where("false")
    assert stage(spark, none, "").count() == 0
    assert stage(spark, spark.createDataFrame([row(1, None), row(2, ""), row(3, None)], SCHEMA), "").count() == (0 if name == "quality_rules" else 3)


def test_near_duplicates_and_repeats(spark, docs):
    got = collections.Counter(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert got[3] == 1 and got[None] == 1 and all(n == 1 for n in got.values())


def test_operators_return_clashing_columns_under_other_names(spark, docs):
    assert suffix_dedup.deduplicated(docs, "kept", "n_bytes").columns[:3] == ["doc_id", "docs_kept", "docs_n_bytes"]
    assert mixing.mixed(docs, carried=("taken", "sid")).columns[-2:] == ["docs_taken", "sid"]
    assert sp.encoded(docs, "ids", "docs_ids").columns[2:4] == ["docs_ids", "docs_docs_ids"]


def test_a_cluster_needs_a_shared_folder(spark):
    class Conf:
        def get(self, *_):
            return None

    class Option:
        def isDefined(self):
            return False

    class Session:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"

            class _jsc:
                @staticmethod
                def sc():
                    return type("SC", (), {"getCheckpointDir": staticmethod(lambda: Option())})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())
    Session.sparkContext.master = "local-cluster[3,2,1024]"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())
    Session.sparkContext.master = "local[4]"
    assert common.shared_dir(Session()).startswith("file:")
