import hashlib
import json

import pytest

from strandlake.sources import uniprot


class Pages:
    def __init__(self, pages, lines=()):
        self.made, self.lines = pages, lines

    def pages(self, endpoint, query):
        return iter([[json.dumps(x) for x in page] for page in self.made.get((endpoint, query), [])])

    def fasta(self, query):
        return self.lines


PROTEOMES = [
    {"id": "UP1", "proteinCount": 9, "geneCount": 4, "proteomeType": "Reference", "taxonomy": {"taxonId": 9606, "scientificName": "Homo sapiens"}, "proteomeStatistics": {"reviewedProteinCount": 3, "unreviewedProteinCount": 5}},
    {"id": "UP2", "proteinCount": True, "taxonomy": {"taxonId": 10090}, "proteomeStatistics": {"unreviewedProteinCount": 5}},
]


def test_catalog(spark, tmp_path):
    pages = Pages({("proteomes", "*"): [PROTEOMES[:1], PROTEOMES[1:]]})
    rows = uniprot.catalog_rows(uniprot.fetched(spark, pages, "proteomes", uniprot.catalog_query("all"), str(tmp_path / "p")))
    made = {r["proteome_id"]: tuple(r)[1:] for r in rows.collect()}
    assert made == {"UP1": (9606, "Homo sapiens", "Reference", 3, 9, 4), "UP2": (10090, None, None, None, 5, None)}
    assert [r["proteome_id"] for r in uniprot.filter_catalog(rows, " SAPIENS ").collect()] == ["UP1"]
    assert uniprot.filter_catalog(rows, "1009").count() == 1 and uniprot.filter_catalog(rows, "").count() == 2


def test_records_and_resolution(spark, tmp_path):
    gene = {"canonicalProtein": {"id": "P1", "uniProtkbId": "A_HUMAN", "entryType": "UniProtKB reviewed (Swiss-Prot)", "proteinName": "Name", "geneName": "G", "proteinExistence": "1: level", "sequenceVersion": 2, "organism": {"scientificName": "Homo", "taxonId": 9606}, "sequence": {"value": "ACD"}}}
    frame = spark.createDataFrame([(json.dumps(g),) for g in (gene, {}, {"canonicalProtein": {"id": "Q"}})], "json string")
    assert [tuple(r) for r in uniprot.fasta_records(frame).collect()] == [("sp|P1|A_HUMAN Name OS=Homo OX=9606 GN=G PE=1 SV=2", "ACD")]
    pages = Pages({("proteomes", "(taxonomy_id:7)"): [PROTEOMES]}, [">a", "AC"])
    assert json.loads(uniprot.resolve_taxonomy(pages, 7)[0])["id"] == "UP1"
    assert uniprot.download_fasta(pages, "q", str(tmp_path / "a.fasta")) == 1
    with pytest.raises(LookupError):
        uniprot.resolve_taxonomy(pages, 8)


def test_committed_catalogs(spark, tmp_path):
    for name, content in (("20240101", b"one"), ("20240202", b"two"), ("20240303", b"three")):
        (tmp_path / f"{name}.parquet").write_bytes(content)
        stated = hashlib.md5(b"broken" if name == "20240202" else content).hexdigest()
        (tmp_path / f"{name}.json").write_text(json.dumps({"name": f"{name}.parquet", "md5": stated}))
    (tmp_path / "20240404.parquet").write_bytes(b"no manifest")
    assert [r["name"] for r in uniprot.committed_catalogs(spark, str(tmp_path)).collect()] == ["20240303.parquet", "20240101.parquet"]
