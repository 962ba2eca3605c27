"""Landed pages as compressed files."""

import glob
import json

from areascope.sources import ingest as ING
from areascope.sources import landed as LD

SF = "/root/testdata/sf0.001"


def folder(path):
    return path.removeprefix("file:")


def test_landed_pages_are_compressed_and_read_as_they_were(spark):
    docs = LD.school_documents(spark, SF)
    path = LD.land_documents(docs, "compressed")
    files = glob.glob(f"{folder(path)}/part-*")
    assert files and all(f.endswith(".gz") for f in files)
    back = spark.read.text(path)
    key = lambda d: sorted(json.dumps({**json.loads(r[0]), "results": sorted(json.loads(r[0])["results"], key=str)}) for r in d.collect())
    assert key(back) == key(docs)
    assert ING.read_school_pages(spark, path, multi_line=False).count() == docs.count()
