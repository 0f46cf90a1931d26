"""Tables of the genome data model, as DDL. A missing attribute is NULL."""

GENOME = "genome_id string, descr string, source_path string"
SCAFFOLD = "genome_id string, scaffold_id string, realname string, seq string"
FEATURE = "genome_id string, scaffold_id string, ord int, type string, start int, end int, strand string, locus_tag string, gene string, gene_synonym string, protein_id string, translation string, pseudo boolean"
GENE = "gene_id string, genome_id string, scaffold_id string, start int, end int, strand string, transl string, pseudo boolean, svm_candidate boolean, svm_hit boolean, intergenic boolean, cog double"
HIT = "q string, s string, pident double, length int, mismatch int, gapopen int, qlen int, slen int, evalue double, bitscore double"
GENE_DOMAIN = "gene_id string, db string, domain_id string, ali_from int, ali_to int, evalue double"
DOMAIN_CATEGORY = "category string, domain_id string, descr string"
CLUSTER = "cluster_id string, genome_id string, scaffold_id string, strand string, start int, end int"
CLUSTER_GENE = "cluster_id string, gene_id string, ord int, is_core boolean"
EXTERNAL_CLUSTER = "genome_id string, contig string, ext_id string, product string, start int, end int"
EDGE = "src string, dst string, kind string, weight double"
TAX_NODE = "tax_id string, parent_id string, rank string"
ASSEMBLY = "accession string, category string, tax_id string, name string, strain string, level string, ftp string"
