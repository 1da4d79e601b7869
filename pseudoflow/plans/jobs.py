"""End-to-end jobs: read -> pseudonymize -> write both halves; read -> restore -> write."""

from __future__ import annotations

import uuid
from typing import Optional

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pseudoflow.operators import mask as M
from pseudoflow.operators import unmask as U
from pseudoflow.options import MaskOptions
from pseudoflow.sources import committed_run, read_documents, read_mapping, write_run


def mask_job(spark: SparkSession, input_path: str, masked_path: str, mapping_path: str, *,
             options: MaskOptions = MaskOptions(engines="regex"), fmt: str = "parquet", text_col: str = "text",
             key_col: str = "doc_id", session_col: Optional[str] = None, order_col: Optional[str] = None,
             lang_col: Optional[str] = None, literals_col: Optional[str] = None, extractor=None,
             run_id: Optional[str] = None, session_buckets: int = 64, **read_options) -> str:
    """I1 -> M4 (-> N1) -> I2.  Without ``session_col`` every row is its own session (no shuffle);
    with it, rows of a session share numbering in ``order_col`` order.

    ``literals_col`` holds a row's own literals.  With an ``extractor`` (engines llm or hybrid) the entities come from the
    masked text.  ``run_id`` (random unless given) enters the ids of sessions that the input doesn't name; it is returned.
    """
    docs = read_documents(spark, input_path, fmt, text_col, key_col, **read_options)
    run_id = run_id or uuid.uuid4().hex
    kw = {"options": options, "run_id": run_id} | ({"lang_col": lang_col} if lang_col else {}) | ({"literals_col": literals_col} if literals_col else {})
    if extractor is not None and options.engines != "regex":
        res = M.mask_with_extractor(docs, extractor, text_col, key_col, session_col=session_col, order_col=order_col, **kw)
    elif session_col is None:
        res = M.mask_rows(docs, text_col, key_col, persist=True, **kw)
    else:
        res = M.mask_sessions(docs, text_col, key_col, session_col=session_col, order_col=order_col, **kw)
    write_run(res.masked, res.mapping, masked_path, mapping_path, run_id, session_buckets)
    return run_id


def restore_job(spark: SparkSession, masked_path: str, mapping_path: str, out_path: str, *,
                texts_path: Optional[str] = None, text_col: str = "masked_text", key_col: str = "doc_id",
                session_col: str = "session_id") -> None:
    """Restore a table of (key, session_id, text) — by default the masked table itself, or any
    other table such as a model's answers (``texts_path``) — against a stored mapping.

    A session is known when the last committed run has it in its registry (even without hits); texts of other
    sessions become error rows.
    """
    run = committed_run(spark, mapping_path)
    texts = spark.read.parquet(texts_path or (run["masked"] if run else masked_path))
    # sessions without hits are known too: the registry has them, or else the masked table
    known = spark.read.parquet(run["sessions"]) if run else spark.read.parquet(masked_path).select(F.col(session_col).alias("session_id"))
    U.unmask_checked(texts, read_mapping(spark, mapping_path), text_col, key_col, session_col, known_sessions=known) \
        .write.mode("overwrite").parquet(out_path)
