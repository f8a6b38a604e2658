"""Sinks of a cohort write a bounded number of folders, however many participants there are."""

import os
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from check import compare  # noqa: E402

from saccade.operators.prompts import parse_prompt_json, prompt_json  # noqa: E402
from saccade.plans import ORACLES, QUERIES, q_sources  # noqa: E402
from saccade.session import shared_folder  # noqa: E402
from saccade.sources import writers  # noqa: E402

MANY = 150


def folders(path):
    return [where for where, _, files in os.walk(path) if any(f.startswith("part-") for f in files)]


def test_prompt_documents_share_folders(spark, tmp_path):
    rows = [(f"p{i}" if i % 9 else f" p, \"{i}\"/=", s, "ab"[s % 2], s, i, 2, 1) for i in range(MANY) for s in range(3)]
    clicks = spark.createDataFrame(rows, "participant_id string, seq long, label string, frame int, x int, y int, positive int")
    documents = prompt_json(clicks, ["a", "b"], 2)
    writers.write_prompt_documents(documents, str(tmp_path / "docs"))
    assert len(folders(tmp_path / "docs")) <= writers.SHARED_FOLDERS < documents.count()
    back = q_sources._written_prompts(spark, str(tmp_path / "docs"))
    assert back.columns == ["participant_id", "part", "json"]
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, documents.collect()))
    assert parse_prompt_json(back).count() == len(rows)


def test_prompt_documents_in_own_folders(spark, tmp_path):
    documents = spark.createDataFrame([("p", 0, "{}"), ("p", 1, "{}"), ("q", 0, "{}")], "participant_id string, part long, json string")
    writers.write_prompt_documents(documents, str(tmp_path / "docs"), own_folders=True)
    assert sorted(os.path.relpath(f, tmp_path / "docs") for f in folders(tmp_path / "docs")) == [
        "participant_id=p/part=0", "participant_id=p/part=1", "participant_id=q/part=0"]


def events_table(spark, folder):
    """Some events of each of many users, with repeats of one label."""
    at = F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id") * 7_000_000)
    kind = F.element_at(F.array(*map(F.lit, ["click", "view", "error", "signup", "purchase"])), (F.floor(F.col("id") / MANY / 2) % 5 + 1).cast("int"))
    spark.range(MANY * 8).select(
        F.col("id").alias("event_id"), at.cast("timestamp_ntz").alias("ts"), (F.col("id") % MANY).alias("user_id"), kind.alias("event_type"),
        (F.col("id") % 17).cast("double").alias("value"), F.format_string('{"k": %d}', F.col("id") % 50).alias("props")
    ).coalesce(1).write.parquet(str(folder / "events.parquet"))
    return str(folder)


@pytest.mark.parametrize("name, written", [("s05_prompt_scan", "prompts"), ("s10_code_sink", "codes"), ("s01_run_scan", "runs"), ("s09_run_sink", "runs")])
def test_queries_write_few_folders(spark, tmp_path, name, written):
    sf_dir, kept = events_table(spark, tmp_path), shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(kept))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf_dir}/events.parquet/*.parquet'")
    good, text, _ = compare(spark, con, sf_dir, name, QUERIES[name], ORACLES[name])
    assert good, text
    new = [n for n in os.listdir(kept) if n not in before and n.startswith(f"{written}-")]
    assert len(new) == 1 and len(folders(os.path.join(kept, new[0]))) <= writers.SHARED_FOLDERS
