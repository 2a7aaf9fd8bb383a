"""The SQL of vectorise_short_sources states the splitter's rules: short texts may have several chunks."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from tesserae.functions.split import split
from tesserae.plans.queries import ORACLES, QUERIES


def test_short_texts_of_several_chunks(spark, tmp_path):
    texts = ["word " * 384, "word " * 385, "ed, " * 380, "A b. " * 190, "a\n\n" + "x " * 384, "x " * 385 + "\n\ny", " \n ", "", None, "one", ("ed, " * 40 + "\n") * 9, "ed,ed " * 300, "w " * 386]
    docs = pa.table({"doc_id": pa.array([2 * i for i in range(len(texts))], pa.int64()), "text": texts, "lang": ["en"] * len(texts), "source": ["src1"] * len(texts)})
    pq.write_table(docs, tmp_path / "documents.parquet")
    pq.write_table(pa.table({"vec_id": pa.array([0, 200], pa.int64()), "label": [1, 2], "embedding": [[1.0], [2.0]]}), tmp_path / "embeddings.parquet")
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    want = sorted(con.execute(ORACLES["vectorise_short_sources"]).fetchall())
    got = sorted((r.source, r.order, r.content) for r in QUERIES["vectorise_short_sources"](spark, str(tmp_path)).collect())
    short = {f"source:{2 * i}": x for i, x in enumerate(texts) if x is not None and int(len(x.split()) * 1.3) <= 500}
    assert got == want and [r for r in got if r[0] in short] == sorted((k, i, c) for k, x in short.items() for i, c in enumerate(split(x)))
    assert any(r[1] > 0 for r in got if r[0] in short)
