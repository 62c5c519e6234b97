"""Tables of the binning engine: names, columns and sentinels."""

from __future__ import annotations

from pyspark.sql import types as T

#: Sentinels of the public tables. Inside plans a missing value is NULL.
NULL_TEXT, NOT_ASSIGNED, NO_INDEX = "NULL_ST", "not assigned", -1
#: Separators of the text codecs.
HIT_SEPARATOR, SPECTRUM_SEPARATOR = "###", "#"

S, L, D = T.StringType(), T.LongType(), T.DoubleType()


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


GENES = _struct(
    gene_id=S, locus_tag=S, cog_id=S, cog_description=S, cog_Evalue=D, scaffold=S, pfam=S, pfam_description=S, pfam_Evalue=D, dna_length=L, protein_length=L, start=L, end=L, strand=S, gc=D
)
SEQUENCES = _struct(gene_id=S, locus_tag=S, description=S, sequence=S)
SCAFFOLDS = _struct(scaffold_id=S, scaffold=S, sequence=S, length=L, GC=D)
HITS = _struct(title=S, evalue=D, score=D, bits=D)
BLAST_RESULTS = _struct(gene_id=S, hits=T.ArrayType(HITS))
ASSIGNMENTS = _struct(scaffold=S, genus=S, bits=D)
KMER_COMPARISON = _struct(scaffold=S, genus=S, distance=D)
LABEL_PROPAGATION = _struct(scaffold=S, genus=S, probability=D)
KMEANS = _struct(scaffold=S, cluster=L)
KMEANS_LP = _struct(scaffold=S, cluster=L, probability=D)
DPGMM = _struct(scaffold=S, cluster=L, probability=D)

TABLES = {
    "Genes": GENES, "Sequences": SEQUENCES, "Scaffolds": SCAFFOLDS, "BlastResults": BLAST_RESULTS, "ScaffoldsAssignments": ASSIGNMENTS, "ScaffoldKmerComparison": KMER_COMPARISON,
    "LabelPropagationResults": LABEL_PROPAGATION, "KmeansResults": KMEANS, "KmeansLPResults": KMEANS_LP, "DPGMMResults": DPGMM,
}
#: The three scalar types that a table may be declared with.
SCALARS = {"int": L, "float": D, "str": S}
