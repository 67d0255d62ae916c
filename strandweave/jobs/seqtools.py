"""Command line: read an alignment, mask columns, filter fragments, rename, write. The order is fixed.

    spark-submit strandweave/jobs/seqtools.py in.fasta out --mask-sites-ratio 0.1 --filter-ratio 0.5
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.operators import columns as C
from strandweave.operators import rows as W
from strandweave.sources import formats as S

def read_names(spark: SparkSession, path: str) -> DataFrame:
    """(taxon, name) from a small file of lines that alternate between the two; blank ones are passed over."""
    lines = spark.read.text(path, wholetext=True).select(F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "").alias("x"))
    pairs = F.transform(F.sequence(F.lit(0), (F.size("x") / 2).cast("int") - 1), lambda i: F.struct(F.get("x", 2 * i).alias("taxon"), F.get("x", 2 * i + 1).alias("name")))
    return lines.where("size(x) > 1").select(F.explode(pairs).alias("p")).select("p.*")


def transform(aln: DataFrame, mask_sites: float | None = None, mask_sites_ratio: float | None = None, filter_least: int | None = None, filter_ratio: float | None = None, filter_median: float | None = None, names: DataFrame | None = None) -> DataFrame:
    """Absolute bounds come before ratios where both are given."""
    if mask_sites:
        aln = C.mask_sites(aln, mask_sites)
    elif mask_sites_ratio:
        aln = C.mask_sites_ratio(aln, mask_sites_ratio)
    if filter_median is not None or filter_least is not None or filter_ratio is not None:
        aln = W.filter_fragments(aln, filter_least, filter_ratio, filter_median)
    return aln if names is None else W.rename(aln, names)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("source")
    p.add_argument("target")
    p.add_argument("--informat", choices=sorted(S.READERS), default="fasta")
    p.add_argument("--outformat", choices=sorted(S.WRITERS), default="fasta")
    p.add_argument("--compression", choices=["none", "gzip"], default="none")
    p.add_argument("--mask-sites", type=float)
    p.add_argument("--mask-sites-ratio", type=float)
    p.add_argument("--filter-least", type=int)
    p.add_argument("--filter-ratio", type=float)
    p.add_argument("--filter-median", type=float)
    p.add_argument("--names", help="file of taxon and name lines in turn")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("seqtools").getOrCreate()
    names = read_names(spark, a.names) if a.names else None
    out = transform(S.reader(a.informat)(spark, a.source), a.mask_sites, a.mask_sites_ratio, a.filter_least, a.filter_ratio, a.filter_median, names)
    S.write(out, a.target, a.outformat, a.compression)


if __name__ == "__main__":
    main()
