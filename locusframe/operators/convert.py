"""Conversions between genotype calls, sequences and VCF rows, and selections on them."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.functions import bases as B
from locusframe.operators.intervals import pairs_of_intervals, points_in_intervals, reduce_intervals
from locusframe.operators.joins import broadcast_up_to
from locusframe.operators.merge import merge_sites
from locusframe.operators.sites import letter

SITE = ["scaffold", "position"]


def select_samples(calls: DataFrame, keep: list | None = None, drop: list | None = None) -> DataFrame:
    """Calls of the samples in ``keep`` (all if not given) that are not in ``drop``."""
    if keep is not None:
        calls = calls.where(F.col("sample").isin(*keep))
    return calls.where(~F.col("sample").isin(*drop)) if drop else calls


#: Letters of the pieces in which long sequences are taken up, so that no step goes through a sequence for each of its letters.
PIECE = 256
#: Positions of a scaffold whose letters are joined first.
STRETCH = 50_000


def _in_pieces(seqs: DataFrame, name: str) -> DataFrame:
    """scaffold, name, t, piece: sequences by pieces, dealt out."""
    n = int(seqs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return seqs.select("scaffold", name, F.posexplode(B.pieces(F.col("seq"), PIECE)).alias("t", "piece")).repartition(n, "scaffold", "t")


def sequences_to_sites(seqs: DataFrame, name: str = "name") -> DataFrame:
    """scaffold, position, name, base: a row per letter of aligned sequences (scaffold, name, seq).

    Positions count from 1 in each sequence. A set of single contigs is given with its
    names as ``scaffold``; several alignments have a scaffold each.
    """
    letters = F.posexplode(F.filter(F.split("piece", ""), lambda x: x != "")).alias("i", "base")
    return _in_pieces(seqs, name).select("scaffold", name, "t", letters).select("scaffold", (F.col("t").cast("long") * PIECE + F.col("i") + 1).alias("position"), name, "base")


def _order(order: list[str] | None) -> Column:
    return F.col("name") if order is None else F.array_position(F.array(*map(F.lit, order)), F.col("name"))


def sites_to_lines(sites: DataFrame, order: list[str] | None = None) -> DataFrame:
    """(scaffold, position, samples): ``sequences_to_sites`` as genotype rows, names in order."""
    x = sites if order is None else sites.where(F.col("name").isin(*order))
    cells = F.transform(F.array_sort(F.collect_list(F.struct(_order(order).alias("o"), "name", "base"))), lambda v: F.struct(v["name"].alias("sample"), v["base"].alias("gt")))
    return x.groupBy(*SITE).agg(cells.alias("samples"))


def sequences_to_lines(seqs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """(scaffold, position, samples): ``sites_to_lines`` of ``sequences_to_sites`` of (scaffold, name, seq).

    Pieces of all sequences meet, and are read across where they are; no letter is a row of its own.
    """
    x = seqs if order is None else seqs.where(F.col("name").isin(*order))
    x = _in_pieces(x, "name").groupBy("scaffold", "t").agg(F.array_sort(F.collect_list(F.struct(_order(order).alias("o"), "name", "piece"))).alias("v"))
    width = F.array_max(F.transform("v", lambda v: F.length(v["piece"])))
    x = x.select("scaffold", "t", "v", F.explode(F.sequence(F.lit(1), width)).alias("i"))
    here = F.filter(F.transform("v", lambda v: F.struct(v["name"].alias("sample"), F.substring(v["piece"], F.col("i"), F.lit(1)).alias("gt"))), lambda v: v["gt"] != "")
    return x.select("scaffold", (F.col("t").cast("long") * PIECE + F.col("i")).alias("position"), here.alias("samples"))


def window_sequences(placed: DataFrame, *keys: str, min_sites: int = 1, stretch: int | None = None) -> DataFrame:
    """keys, sample, hap, first_site, last_site, seq: each haplotype's letters per window.

    ``placed`` are calls with the windows' keys; with the scaffold alone as key the
    windows are contigs. Missing calls are N. For long windows letters are joined by
    stretches of so many positions first, so that a task has a window's text, not its calls.
    """
    own = [*keys, "sample", "hap"]
    stretches = [F.floor(F.col("position") / stretch).alias("_s")] if stretch else []
    g = placed.groupBy(*own, *stretches).agg(F.array_sort(F.collect_list(F.struct("position", letter(F.col("allele")).alias("b")))).alias("x"))
    ends = [F.col("x")[0]["position"].alias("first_site"), F.element_at("x", -1)["position"].alias("last_site")]
    text = F.array_join(F.transform("x", lambda v: v["b"]), "").alias("seq")
    if not stretch:
        return g.where(F.size("x") >= min_sites).select(*own, *ends, text)
    g = g.select(*own, "_s", F.size("x").alias("_n"), *ends, text).groupBy(*own).agg(
        F.sum("_n").alias("_n"), F.min("first_site").alias("first_site"), F.max("last_site").alias("last_site"), F.array_sort(F.collect_list(F.struct("_s", "seq"))).alias("x")
    )
    return g.where(F.col("_n") >= min_sites).select(*own, "first_site", "last_site", F.array_join(F.transform("x", lambda v: v["seq"]), "").alias("seq"))


def subset_sequences(seqs: DataFrame, regions: DataFrame, left: int = 0, right: int = 0, keep_names: bool = False) -> DataFrame:
    """Pieces of sequences (name, seq, any others) by regions (chrom, start, end, strand).

    Null ends reach to the ends of the sequence; regions are widened by ``left`` and
    ``right`` and cut off at the ends; a minus strand gives the reverse complement. Names tell
    the piece, unless the whole sequence is taken or names are kept. Regions of unknown names
    give nothing. A region is read from the pieces of ``PIECE`` letters that it meets, so it
    costs its own length, wherever it lies.
    """
    others = [c for c in seqs.columns if c not in ("name", "seq")]
    cut = seqs.select(*others, "name", B.pieces(F.col("seq"), PIECE).alias("_pieces"), F.length("seq").cast("long").alias("_n"))
    # dealt out evenly; without this exchange generated code would cut a sequence up anew for each region
    cut = cut.repartition(int(seqs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    x = cut.join(broadcast_up_to(regions), F.col("name") == F.col("chrom"))
    whole = F.col("start").isNull() & F.col("end").isNull() & (F.col("strand") == "+")
    a = F.greatest(F.lit(1).cast("long"), F.coalesce("start", F.lit(1)) - left)
    z = F.least("_n", F.coalesce("end", "_n") + right)
    a, z = F.when(whole, 1).otherwise(a), F.when(whole, F.col("_n")).otherwise(z)
    lo, hi = F.floor((a - 1) / PIECE), F.floor((z - 1) / PIECE)
    near = F.array_join(F.slice("_pieces", (lo + 1).cast("int"), F.greatest(F.lit(0), hi - lo + 1).cast("int")), "")
    piece = F.substring(near, (a - lo * PIECE).cast("int"), F.greatest(F.lit(0), z - a + 1).cast("int"))
    piece = F.when(F.col("strand") == "-", B.reverse_complement(piece)).otherwise(piece)
    label = F.concat("name", F.lit(":"), a.cast("string"), F.lit("-"), z.cast("string"), F.lit(":"), "strand")
    return x.select(*others, (F.col("name") if keep_names else F.when(whole, F.col("name")).otherwise(label)).alias("name"), piece.alias("seq"))


def lift_vcf(vcf: DataFrame, transfers: DataFrame) -> DataFrame:
    """VCF rows (chrom, pos, ref, alt, ...) on new scaffolds; rows in no piece are left out.

    On a minus strand the position runs backwards and ref and alt are complemented.
    """
    t = transfers.select("new_scaf", "new_start", "new_end", F.col("scaf").alias("chrom"), "start", "end", "strand")
    x = points_in_intervals(vcf, t, "chrom", "pos")
    minus = F.col("strand") == "-"
    turn = lambda s: F.when(minus, B.complement(s)).otherwise(s)
    pos = F.when(minus, F.col("new_end") - (F.col("pos") - F.col("start"))).otherwise(F.col("new_start") + F.col("pos") - F.col("start"))
    x = x.withColumns({"pos": pos, "ref": turn(F.col("ref")), "alt": F.transform("alt", lambda a: turn(a)), "chrom": F.col("new_scaf")})
    return x.select(*vcf.columns)


def merge_vcfs(vcfs: list[DataFrame], how: str = "intersect", union_min: int = 1, lengths: DataFrame | None = None, missing: str = "N/N", **options) -> DataFrame:
    """Sites of several VCFs as one table: scaffold, position, gt_0 ... (samples of a file joined by tabs).

    Each file is filtered and decoded by ``vcf_calls`` with ``options``; of repeated sites
    of a file the least row counts. ``how`` is as for ``merge_sites``.
    """
    from locusframe.sources.text import vcf_calls

    def table(v: DataFrame) -> DataFrame:
        once = v.groupBy("chrom", "pos").agg(F.min_by(F.struct(*[c for c in v.columns if c not in ("chrom", "pos")]), F.struct("ref", F.array_join("alt", ","))).alias("x")).select("chrom", "pos", "x.*")
        c = vcf_calls(once, **options)
        cells = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sample", "gt"))), lambda x: x["gt"]), "\t")
        return c.groupBy(*SITE).agg(cells.alias("gt"))

    return merge_sites([table(v) for v in vcfs], how, union_min, lengths=lengths, missing=missing)


def genes_in_regions(genes: DataFrame, regions: DataFrame | None = None, exclude: list[str] = ()) -> DataFrame:
    """Genes (scaffold, mrna, start, end, ...) that lie wholly in the union of ``regions``, outside of ``exclude``."""
    if exclude:
        genes = genes.where(~F.col("scaffold").isin(*exclude))
    if regions is None:
        return genes
    whole = reduce_intervals(regions.select(F.col("scaffold").alias("chrom"), "start", "end")).withColumn("id", F.monotonically_increasing_id())
    inner = genes.select(F.struct("scaffold", "mrna").alias("id"), F.col("scaffold").alias("chrom"), "start", "end")
    hit = pairs_of_intervals(whole.select("id", "chrom", "start", "end"), inner, "contain").select("b_id.scaffold", "b_id.mrna").distinct()
    return genes.join(hit, ["scaffold", "mrna"], "left_semi")


def sample_alleles(calls: DataFrame) -> DataFrame:
    """scaffold, position, sample, alleles: the letters a sample has at a site, missing left out."""
    have = F.array_join(F.transform(F.array_sort(F.collect_set("allele")), lambda a: letter(a)), "")
    return calls.groupBy(*SITE, "sample").agg(have.alias("alleles"))


def rename_scaffolds(rows: DataFrame, lookup: DataFrame, backwards: bool = False) -> DataFrame:
    """``rows`` with scaffolds renamed by ``lookup`` (old, new); unknown ones keep their names."""
    a, b = ("new", "old") if backwards else ("old", "new")
    names = broadcast_up_to(lookup.select(F.col(a).alias("_from"), F.col(b).alias("_to")).dropDuplicates(["_from"]))
    return rows.join(names, F.col("scaffold") == F.col("_from"), "left").withColumn("scaffold", F.coalesce("_to", "scaffold")).drop("_from", "_to")


def unique_in_order(rows: DataFrame, value: str, order: str) -> DataFrame:
    """The distinct values, each with the least ``order`` it has, by which they can be sorted."""
    return rows.groupBy(value).agg(F.min(order).alias("first"))


def first_sites(sites: DataFrame, n: int) -> DataFrame:
    """The first ``n`` sites in order; partial top-n per task, no full sort."""
    return sites.orderBy(*SITE).limit(n)


def site_table(geno: DataFrame) -> DataFrame:
    """scaffold, position, name, value: a numeric site table read by ``read_geno``; other cells are null."""
    x = geno.select(*SITE, F.explode("samples").alias("s"))
    return x.select(*SITE, F.col("s.sample").alias("name"), F.col("s.gt").try_cast("double").alias("value"))


def alternating_name(sample: Column, hap: Column) -> Column:
    """A haplotype's name: the sample's with _A, _B, ... after it."""
    return F.concat(sample.cast("string"), F.lit("_"), F.char(F.lit(65) + hap))
