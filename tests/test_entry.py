import collections
import decimal
import re
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from pyspark.sql import functions as F

import __spark_entry__ as entry
from cloneframe.functions import kernels
from cloneframe.operators import filters, haplotypes, usage
from cloneframe.plans import catalogue, files  # noqa: F401
from cloneframe.plans.views import view

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 9) if v == v else "nan"
    if isinstance(v, decimal.Decimal):
        return float(v)
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(want.columns) == columns
    quoted = ", ".join(f'"{c}"' for c in columns)
    rows = duck.sql(f"select {quoted} from ({catalogue.oracle_sql()[name]})").fetchall()
    got = df.select(*(f"`{c}`" for c in columns)).collect()
    assert sorted(repr(plain(tuple(r))) for r in got) == sorted(repr(plain(r)) for r in rows)


def test_every_query_has_sql_or_a_test():
    assert set(catalogue.queries()) - set(catalogue.oracle_sql()) == {"barcode_consensus", "cluster_plots", "discover_v", "haplotypes", "upstream_consensus"}


def groups_of(rows, key):
    out = collections.defaultdict(list)
    for r in rows:
        out[r[key]].append(r)
    return out


def test_barcode_consensus(spark):
    reads = [(r.ord, r.name, r.sequence[:6], re.sub("^G+", "", r.sequence[6:])) for r in view(spark, SF, "reads").orderBy("ord").collect()]
    want, n = [], 0
    for barcode, rows in sorted(groups_of(reads, 2).items()):
        name, made = rows[0][1], rows[0][3]
        if len(rows) >= 3:
            found = kernels.consensus(kernels.star_alignment([r[3] for r in rows]), 0.501)
            if "N" not in found:
                n += 1
                name, made = f"consensus{n}", found
        want.append((f"{name};barcode={barcode};size={len(rows)};", made, len(rows)))
    assert sorted(map(tuple, catalogue.queries()["barcode_consensus"](spark, SF).collect())) == sorted(want)


def test_cluster_plots(spark):
    rows = view(spark, SF, "assignments").select("row_id", "v_call", "cdr3", F.xxhash64(F.lit(1), "row_id").alias("h")).collect()
    got = {r.gene: r for r in catalogue.queries()["cluster_plots"](spark, SF).collect()}
    want = {g: sorted(x, key=lambda r: (r.h, r.row_id))[:300] for g, x in groups_of(rows, "v_call").items() if len(x) >= 5}
    assert got.keys() == want.keys()
    for g, x in want.items():
        ids = kernels.cut_by_ratio(kernels.distances([r.cdr3 for r in x]), 5, strict=False)
        assert got[g].n_sequences == len(x) and got[g].clusters == ids and got[g].n_clusters == len(set(ids) - {0})


def test_upstream_consensus(spark):
    rows = view(spark, SF, "leaders").filter("V_SHM <= 1").select("row_id", "v_call", "UTR", F.xxhash64(F.lit(1), "row_id").alias("h")).collect()
    want = []
    for g, x in groups_of(rows, "v_call").items():
        least = sorted((len(r.UTR) for r in x), reverse=True)[min(10, len(x)) - 1]
        s = [r.UTR for r in sorted(x, key=lambda r: (r.h, r.row_id)) if len(r.UTR) >= least and r.UTR]
        want.append((g, s[0] if len(set(s)) == 1 else kernels.iterative_consensus(s, 0.75).lstrip("N"), len(s)))
    assert sorted(map(tuple, catalogue.queries()["upstream_consensus"](spark, SF).collect())) == sorted(want)


def test_haplotypes(spark):
    """Each block holds every expressed gene of its type, in the classes that the entries of its pair have."""
    rows = filters.haplotype(view(spark, SF, "assignments"))
    blocks = haplotypes.analyse(view(spark, SF, "assignments"))
    got = catalogue.queries()["haplotypes"](spark, SF).collect()
    assert [(r.block, r.gene_type, *r[2:]) for r in got] == [(i, b.gene_type, *x) for i, b in enumerate(blocks) for x in b.rows]
    for b in blocks:
        by = "J" if b.gene_type in "VD" else "V"
        expressed = {r.gene for r in usage.expression_by_gene(rows, b.gene_type).collect()}
        want = {tuple(r) for r in haplotypes.entries(usage.coexpression(rows, by, b.gene_type), usage.expression_by_gene(rows, b.gene_type), b.het, by, b.gene_type).select("haplotype1", "haplotype2", "type", "count1", "count2").collect()}
        assert set(b.rows) == want and {(x or y).split("*")[0] for x, y, *_ in b.rows} <= expressed


def test_discover_v(spark):
    """Counts of every candidate against a pass over all rows."""
    made = catalogue._pseudo_reads(view(spark, SF, "assignments")).filter("J_SHM = 0").collect()
    found = catalogue.queries()["discover_v"](spark, SF).collect()
    assert found and len({r.idx for r in found}) == len(found)
    by_call = groups_of(made, "v_call")
    for r in found:
        rows = by_call[r.source]
        exact = [x for x in rows if x.V_nt[:28] == r.consensus[:28]]
        lo, hi = (0, 100) if r.cluster == "all" else map(float, r.cluster.split("-")) if r.cluster != "db" else (None, None)
        size = sum(x.V_errors == 0 for x in rows) if lo is None else sum(lo <= x.V_SHM < hi for x in rows)
        assert (r.exact, r.full_exact, r.cluster_size) == (len(exact), sum(x.V_nt == r.consensus for x in rows), size)
        assert (r.CDR3s_exact, r.Js_exact, r.barcodes_exact) == tuple(len({x[c] for x in exact} - {""}) for c in ("cdr3", "j_call", "barcode"))
        assert r.database_diff == sum(a != b for a, b in zip(r.consensus, next(x.gene for x in rows), strict=True))
        roots = brute_components([(x.j_call, x.cdr3) for x in exact if x.cdr3])
        assert r.clonotypes == roots


def brute_components(nodes):
    nodes = sorted(set(nodes))
    root = list(range(len(nodes)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (j, c) in enumerate(nodes):
        for k in range(i):
            if nodes[k][0] == j and kernels.edits(nodes[k][1], c, 6) <= 6:
                root[find(i)] = find(k)
    return len({find(i) for i in range(len(nodes))})


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_without_the_optional_parts():
    """The driver entry imports without the llm subpackage and the pipeline."""
    root = Path(entry.__file__).parent
    code = "import sys; sys.modules['cloneframe.llm.queries'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'clonotypes' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0
