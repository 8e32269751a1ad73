import hashlib

from pyspark.sql import functions as F

from folio.operators import snapshot
from folio.schemas import TABLES


def test_hashes_are_those_of_the_documented_tree(spark):
    """Leaves move as bytes; the roots are still those of digits, so that snapshots of before can be opened."""
    made = spark.range(300).select(*[(F.concat(F.lit(f.name), "id").cast(f.dataType) if f.dataType.simpleString() == "string" else F.lit(None).cast(f.dataType)).alias(f.name) for f in TABLES["extracted"]])
    rows = made.select(snapshot._part("extracted").alias("part"), F.to_json(F.struct(*made.columns), {"ignoreNullFields": "false"}).alias("row")).collect()
    sha, wanted = lambda s: hashlib.sha256(s.encode()).hexdigest(), {}
    for part in {r["part"] for r in rows}:
        leaves = sorted(sha(r["row"]) for r in rows if r["part"] == part)
        inner = {d: sha(",".join(x for x in leaves if x[:3] == d)) for d in {x[:3] for x in leaves}}
        wanted[part] = (len(leaves), sha(",".join(sorted(d + h for d, h in inner.items()))))
    assert snapshot.fingerprints("extracted", made) == wanted
