"""Rows of a small graph for tests."""

COLUMNS = "seq long, doc string, chunk string, s string, st string, rel string, o string, ot string, ev string, conf double, status string, aids array<string>"


def kg(spark, *rows):
    full = [dict(seq=i, doc="d", chunk="c", s="Fox", st="Malware", rel="uses", o="Nmap", ot="Tool", ev="Fox uses Nmap", conf=0.9, status="raw", aids=[]) | r for i, r in enumerate(rows)]
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in full], COLUMNS)
