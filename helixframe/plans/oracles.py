"""SQL, in DuckDB's dialect, of the steps that the registered queries share; each part adds to a WITH clause."""

BASES = "translate(regexp_replace(lower(coalesce(text, '')), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'AGTTCAGCTAGCATCGTGCATGACTA')"

_CONTIGS = f"""contigs AS MATERIALIZED (
  SELECT *, length(seq)::INT AS len FROM (
    SELECT source AS genome_id, doc_id AS contig_id, concat_ws('_', lang, doc_id::VARCHAR) AS name, doc_id % 5 = 0 AS circ, {BASES} AS seq FROM documents))"""

CONTIGS = f"WITH {_CONTIGS} "

#: The addresses of the codons in frame 0.
CODON_INDEX = """, indexed AS (
  SELECT genome_id, CASE WHEN length(c) = 3 THEN 16 * (strpos('TCAG', c[1]) - 1) + 4 * (strpos('TCAG', c[2]) - 1) + strpos('TCAG', c[3]) - 1 END::INT AS address
  FROM (SELECT genome_id, unnest(regexp_extract_all(seq, '...')) AS c FROM contigs)) """

_SIDES = """sides AS MATERIALIZED (
  SELECT genome_id, contig_id, name, circ, len, strand, frame, CASE strand WHEN 0 THEN seq ELSE translate(reverse(seq), 'ACGT', 'TGCA') END AS s
  FROM contigs, (VALUES (0), (1)) t(strand), (VALUES (0), (1), (2)) f(frame) WHERE len >= 90)"""

#: Complete ORFs of 90 nt or more, from the first start after a stop to the next stop.
COMPLETE = f"""WITH RECURSIVE {_CONTIGS}, {_SIDES},
codons AS (
  SELECT contig_id, strand, frame, frame + 3 * (i - 1) AS pos, codon IN ('TAA', 'TAG', 'TGA') AS stop
  FROM (SELECT contig_id, strand, frame, unnest(l) AS codon, generate_subscripts(l, 1) AS i
        FROM (SELECT contig_id, strand, frame, regexp_extract_all(substr(s, frame + 1), '...') AS l FROM sides))
  WHERE codon IN ('TAA', 'TAG', 'TGA', 'ATG', 'GTG', 'TTG')),
islands AS (
  SELECT *, coalesce(sum(stop::INT) OVER (PARTITION BY contig_id, strand, frame ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island FROM codons),
spans AS (
  SELECT contig_id, strand, frame, min(pos) FILTER (NOT stop)::INT AS start, max(pos) FILTER (stop)::INT + 3 AS "end", list_sort(list(pos::INT) FILTER (NOT stop)) AS starts
  FROM islands GROUP BY contig_id, strand, frame, island),
complete AS MATERIALIZED (
  SELECT genome_id, contig_id, name, strand, frame, starts, start, "end", "end" - start AS len, nt, s, contig_len,
         (length(nt) - length(translate(nt, 'GC', '')))::INT AS n_gc,
         len(list_filter(regexp_extract_all(nt, '.(.).', 1), lambda x: x = 'G'))::INT AS n_g2,
         CASE strand WHEN 0 THEN start ELSE contig_len - "end" END + 1 AS rstart, CASE strand WHEN 0 THEN "end" ELSE contig_len - start END AS rend
  FROM (SELECT p.*, genome_id, name, s, len AS contig_len, substr(s, start + 1, "end" - start) AS nt FROM spans p JOIN sides USING (contig_id, strand, frame) WHERE start IS NOT NULL AND "end" - start >= 90)) """

#: All ORFs of 90 nt or more, with open ends and circular contigs.
SCAN = f"""WITH RECURSIVE {_CONTIGS}, {_SIDES},
codons AS (
  SELECT contig_id, strand, frame, circ, len, pos, CASE codon WHEN 'ATG' THEN 0 WHEN 'GTG' THEN 1 WHEN 'TTG' THEN 2 ELSE -1 END AS kind
  FROM (SELECT *, frame + 3 * (i - 1) AS pos
        FROM (SELECT contig_id, strand, frame, circ, len, unnest(l) AS codon, generate_subscripts(l, 1) AS i
              FROM (SELECT contig_id, strand, frame, circ, len, regexp_extract_all(substr(CASE WHEN circ THEN s || s ELSE s END, frame + 1), '...') AS l FROM sides)))
  WHERE codon IN ('TAA', 'TAG', 'TGA', 'ATG', 'GTG', 'TTG') AND pos + 3 < CASE WHEN circ THEN 2 * len ELSE len END),
seeded AS (
  SELECT * FROM codons
  UNION ALL
  SELECT contig_id, strand, frame, circ, len, frame, 5 FROM sides s
  WHERE NOT circ AND NOT EXISTS (SELECT 1 FROM codons c WHERE c.contig_id = s.contig_id AND c.strand = s.strand AND c.frame = s.frame AND c.pos = s.frame AND c.kind >= 0)),
islands AS (
  SELECT *, coalesce(sum((kind = -1)::INT) OVER (PARTITION BY contig_id, strand, frame ORDER BY pos, kind DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island FROM seeded),
spans AS (
  SELECT contig_id, strand, frame, circ, len AS contig_len, list(pos::INT ORDER BY pos) FILTER (kind >= 0) AS ps, list(kind ORDER BY pos) FILTER (kind >= 0) AS ks,
         (max(pos) FILTER (kind = -1))::INT AS stop
  FROM islands GROUP BY contig_id, strand, frame, circ, len, island HAVING count(*) FILTER (kind >= 0) > 0),
placed AS (
  SELECT *, coalesce(stop + 3, contig_len) AS "end", 5 * (ks[1] = 5)::INT + 3 * (stop IS NULL)::INT AS edge_type
  FROM spans WHERE NOT (circ AND (stop IS NULL OR ps[1] >= contig_len))),
started AS (
  SELECT *, CASE WHEN ks[1] = 0 THEN ps[1] ELSE coalesce(list_min(list_filter(ps, lambda p, i: ks[i] = 0 AND p - ps[1] <= 75 AND "end" - p >= 90)), ps[1]) END AS start FROM placed),
fit AS (SELECT *, "end" - start AS len FROM started WHERE "end" - start BETWEEN 90 AND 50000),
kept AS (
  SELECT * FROM fit a WHERE NOT EXISTS (SELECT 1 FROM fit b WHERE b.circ AND b.contig_id = a.contig_id AND b.strand = a.strand AND b."end" > b.contig_len AND b."end" - b.contig_len = a."end")),
orfs AS (
  SELECT genome_id, k.contig_id, name, nt, k.strand, k.frame, k.circ, contig_len, array_to_string(ps, ',') AS starts, array_to_string(ks, ',') AS types, start, "end", k.len, edge_type,
         (length(nt) - length(translate(nt, 'GC', '')))::INT AS n_gc, len(list_filter(regexp_extract_all(nt, '.(.).?', 1), lambda x: x = 'G'))::INT AS n_g2,
         (CASE WHEN k.circ AND r < 0 THEN r + contig_len ELSE r END + 1)::INT AS rstart, (CASE WHEN k.circ AND e > contig_len THEN e - contig_len ELSE e END)::INT AS rend
  FROM (SELECT f.*, genome_id, name, substr(s || s, start + 1, f.len) AS nt, CASE f.strand WHEN 0 THEN start ELSE contig_len - "end" END AS r, CASE f.strand WHEN 0 THEN "end" ELSE contig_len - start END AS e
        FROM kept f JOIN sides USING (contig_id, strand, frame)) k) """

_CODE = ", ".join(f"'{c}': '{a}'" for c, a in zip([x + y + z for x in "TCAG" for y in "TCAG" for z in "TCAG"], "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG", strict=True))

PROTEIN = f""", proteins AS (
  SELECT contig_id, strand, "end", 'M' || substr(array_to_string(list_transform(regexp_extract_all(nt, '...'), lambda c: code[c]), ''), 2) AS protein
  FROM complete, (SELECT MAP {{{_CODE}}} AS code)) """

#: Genes: ORFs of linear and circular contigs numbered within a genome by contig, end, strand and start.
GENES = (
    SCAN
    + """, genes AS MATERIALIZED (
  SELECT *, CASE WHEN rstart > rend THEN rstart - contig_len ELSE rstart END AS lo, row_number() OVER (PARTITION BY genome_id ORDER BY contig_id, rend, strand, rstart) - 1 AS idx,
         round(n_gc / len, 6) - 0.4 AS i_score, round(n_gc / len, 6) AS t_score, round(n_g2 * 3 / len, 6) AS r_score FROM orfs) """
)

_AXES = "(VALUES ('A', 1, 1, 1), ('C', -1, 1, -1), ('G', 1, -1, -1), ('T', -1, -1, 1))"

#: Mean features by genome: each k-mer of phase p adds its last base's axes times 3 / len.
ZCURVE = f""", bases AS (
  SELECT genome_id, len, i - 1 AS pos, substr(nt, i, 3) AS w FROM (SELECT genome_id, len, nt, unnest(range(1, len + 1)) AS i FROM complete)),
grams AS (
  SELECT genome_id, pos % 3 AS p, k, substr(w, 1, k - 1) AS prefix, substr(w, k, 1) AS base, sum(3.0 / len) AS weight
  FROM bases, (VALUES (1), (2), (3)) t(k) WHERE length(w) >= k GROUP BY ALL),
axes AS (SELECT b, a, v FROM (SELECT b, unnest([0, 1, 2]) AS a, unnest([x, y, z]) AS v FROM {_AXES} t(b, x, y, z))),
sums AS (
  SELECT genome_id, CASE k WHEN 1 THEN 3 * p WHEN 2 THEN 9 + 12 * p + 3 * (strpos('AGCT', prefix) - 1)
         ELSE 45 + 48 * p + 3 * (4 * (strpos('AGCT', prefix[1]) - 1) + strpos('AGCT', prefix[2]) - 1) END + a AS k, sum(weight * v) AS total
  FROM grams JOIN axes ON base = b GROUP BY ALL),
zcurve AS (
  SELECT g.genome_id, f.k::INT AS k, coalesce(total, 0) / n AS mean
  FROM (SELECT genome_id, count(*) AS n FROM complete GROUP BY genome_id) g CROSS JOIN (SELECT unnest(range(189)) AS k) f LEFT JOIN sums s ON s.genome_id = g.genome_id AND s.k = f.k) """

#: The nine one-base features of every ORF.
MONO = f""", counted AS (
  SELECT genome_id, contig_id, strand, "end", len, p, list_filter(regexp_extract_all(nt, '(.)(.)(.)', p + 1), lambda x: true) AS l FROM complete, (VALUES (0), (1), (2)) t(p)),
mono AS MATERIALIZED (
  SELECT genome_id, contig_id, strand, "end", len, (3 * p + a)::INT AS k,
         3.0 * (len(list_filter(l, lambda x: x IN (plus[1], plus[2]))) - len(list_filter(l, lambda x: x NOT IN (plus[1], plus[2])))) / len AS value
  FROM counted, (VALUES (0, 'AG'), (1, 'AC'), (2, 'AT')) t(a, plus)),
stats AS (SELECT k, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS sd, min(value) AS low, max(value) AS high FROM mono GROUP BY k) """

#: All 189 features of every ORF.
FEATURES = f""", spots AS (
  SELECT contig_id, strand, "end", pos % 3 AS p, k, substr(w, 1, k - 1) AS prefix, substr(w, k, 1) AS base, count(*) AS n
  FROM (SELECT contig_id, strand, "end", i - 1 AS pos, substr(nt, i, 3) AS w FROM (SELECT contig_id, strand, "end", nt, unnest(range(1, len + 1)) AS i FROM complete)), (VALUES (1), (2), (3)) t(k)
  WHERE length(w) >= k GROUP BY ALL),
axes AS (SELECT b, a, v FROM (SELECT b, unnest([0, 1, 2]) AS a, unnest([x, y, z]) AS v FROM {_AXES} t(b, x, y, z))),
summed AS (
  SELECT contig_id, strand, "end", CASE k WHEN 1 THEN 3 * p WHEN 2 THEN 9 + 12 * p + 3 * (strpos('AGCT', prefix) - 1)
         ELSE 45 + 48 * p + 3 * (4 * (strpos('AGCT', prefix[1]) - 1) + strpos('AGCT', prefix[2]) - 1) END + a AS k, sum(n * v) AS total
  FROM spots JOIN axes ON base = b GROUP BY ALL),
feats AS MATERIALIZED (
  SELECT c.genome_id, c.contig_id, c.strand, c."end", f.k::INT AS k, coalesce(s.total, 0)::DOUBLE * 3 / c.len AS value
  FROM complete c CROSS JOIN (SELECT unnest(range(189)) AS k) f LEFT JOIN summed s ON s.contig_id = c.contig_id AND s.strand = c.strand AND s."end" = c."end" AND s.k = f.k),
stats AS (SELECT k, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS sd, min(value) AS low, max(value) AS high FROM feats GROUP BY k) """


def digest(value: str, digits: int, of: str) -> str:
    """One row an ORF: the MD5 of its 189 values, in order, as whole numbers of so many decimals."""
    return f'SELECT contig_id, strand, "end", md5(string_agg(round({value} * 1e{digits})::BIGINT::VARCHAR, \',\' ORDER BY k)) AS digest FROM {of} GROUP BY contig_id, strand, "end"'


LAGGING = """, wanted AS (
  SELECT *, row_number() OVER w - 1 AS i, greatest(0, least(60, ceil(round((n_gc / len - 0.2) * 100, 9))))::INT AS b FROM complete
  WINDOW w AS (PARTITION BY genome_id ORDER BY n_gc / len, contig_id, strand, "end")),
lagging AS (
  SELECT *, (i + least(1, min(b - i) OVER (PARTITION BY genome_id ORDER BY i ROWS UNBOUNDED PRECEDING)))::INT AS bin FROM wanted) """

LABELS = """, labelled AS (
  SELECT substr(name, 1, 2) AS class, CASE WHEN gc >= 20 AND gc < 80 THEN format('{:02d}_{:02d}', floor(gc)::INT - floor(gc)::INT % 5, floor(gc)::INT - floor(gc)::INT % 5 + 5) END AS gc_bin
  FROM (SELECT name, CASE WHEN len > 0 THEN 100 * (length(seq) - length(translate(seq, 'GC', ''))) / len ELSE 0 END AS gc FROM contigs)) """

ORF_CODONS = """, orf_codons AS (SELECT genome_id, unnest(regexp_extract_all(nt, '...')) AS codon FROM complete) """

MERGED = """, ivals AS (SELECT contig_id, rstart - 1 AS start, rend AS "end" FROM complete),
marked AS (SELECT *, max("end") OVER (PARTITION BY contig_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ivals),
grouped AS (SELECT *, sum(CASE WHEN start <= before THEN 0 ELSE 1 END) OVER (PARTITION BY contig_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS g FROM marked),
merged AS (SELECT contig_id, min(start) AS start, max("end") AS "end" FROM grouped GROUP BY contig_id, g) """

GAPS = """, ends AS (SELECT * FROM merged UNION ALL SELECT contig_id, len, len FROM contigs),
gaps AS (
  SELECT * FROM (SELECT contig_id, lag("end", 1, 0) OVER (PARTITION BY contig_id ORDER BY start, "end") + 20 AS lo, start - 20 AS hi FROM ends) WHERE hi - lo >= 90) """

#: Windows around start-like codons 150 to 3 bases before the start of long ORFs, as single bases.
BACKGROUND = """, upstream AS (
  SELECT genome_id, contig_len, s || s || s AS sss, unnest(range(start - 150, start - 3)) AS q FROM complete WHERE len >= 300),
before AS MATERIALIZED (SELECT genome_id, substr(sss, contig_len + q - 50 + 1, 65) AS w FROM upstream WHERE substr(sss, contig_len + q + 1, 3) IN ('ATG', 'GTG', 'TTG')),
background AS (
  SELECT genome_id, substr(w, i, 1) AS base FROM (SELECT genome_id, w, unnest(range(1, 65)) AS i FROM before) WHERE substr(w, i, 1) IN ('A', 'C', 'G', 'T')) """

#: The same as COMPLETE of each source's contigs one behind the other.
ACCESSIONS = COMPLETE.replace(_CONTIGS, f"""contigs AS MATERIALIZED (
  SELECT genome_id, contig_id, n_records, genome_id AS name, false AS circ, seq, length(seq)::INT AS len FROM (
    SELECT source AS genome_id, min(doc_id) AS contig_id, count(*) AS n_records, string_agg(seq, '' ORDER BY doc_id) AS seq
    FROM (SELECT source, doc_id, {BASES} AS seq FROM documents) WHERE seq <> '' GROUP BY source))""")

#: Decoys that each accession is to get, all of which are to be sound.
DECOYS = """, frames AS (SELECT contig_id, count(*) AS n FROM complete GROUP BY contig_id),
room AS (SELECT contig_id, sum(floor((hi - lo) / 90))::BIGINT AS capacity FROM gaps GROUP BY contig_id)
SELECT c.genome_id, n_records, len::BIGINT AS merged_len, coalesce(n, 0)::BIGINT AS n_orfs,
       CASE WHEN n IS NULL THEN 0 ELSE least(greatest(20, least(200, round_even(0.05::DOUBLE * n, 0)::BIGINT)), coalesce(capacity, 0)) END::BIGINT AS n_target, true AS within, true AS valid
FROM contigs c LEFT JOIN frames USING (contig_id) LEFT JOIN room USING (contig_id)"""

DECOYS_RESUMED = DECOYS.replace("true AS within, true AS valid", "'11' AS transl_table, 'ok' AS status")

#: Two-base words of the windows around every start of each complete ORF.
WINDOWS = BACKGROUND + """, candidates AS (
  SELECT genome_id, contig_id, strand, "end", len, start, unnest(starts) AS candidate, unnest(range(len(starts)))::INT AS j, s, contig_len FROM complete),
windows AS (SELECT *, substr(s || s || s, contig_len + candidate - 50 + 1, 65) AS w FROM candidates),
kmers AS MATERIALIZED (
  SELECT genome_id, contig_id, strand, "end", len, start, candidate, j, pos::INT AS pos, substr(w, pos + 51, 2) AS kmer
  FROM (SELECT *, unnest(range(-50, 14)) AS pos FROM windows)),
classed AS (
  SELECT genome_id, CASE WHEN candidate = start THEN 'start' ELSE 'other' END AS class, pos, kmer FROM kmers WHERE len >= 300 AND candidate >= start AND j < 6
  UNION ALL SELECT genome_id, 'background', pos::INT, substr(w, pos + 51, 2) FROM (SELECT genome_id, w, unnest(range(-50, 14)) AS pos FROM before)),
counts AS (SELECT genome_id, class, pos, kmer, count(*) AS n FROM classed GROUP BY ALL) """

LOGP = """, grid AS (
  SELECT genome_id, class, pos::INT AS pos, a || b AS kmer, a
  FROM (SELECT DISTINCT genome_id FROM counts), (VALUES ('background'), ('start'), ('other')) c(class), (SELECT unnest(range(-50, 14)) AS pos), (SELECT unnest(['A', 'C', 'G', 'T']) AS a), (SELECT unnest(['A', 'C', 'G', 'T']) AS b)),
logp AS MATERIALIZED (
  SELECT genome_id, class, pos, kmer, ln((coalesce(n, 0) + 1) / sum(coalesce(n, 0) + 1) OVER (PARTITION BY genome_id, class, pos, a)) AS logp
  FROM grid LEFT JOIN counts USING (genome_id, class, pos, kmer)) """

#: The odds of a start by the background's base shares, and the candidates expected before and after the true start.
PRIORS = """, shares AS (
  SELECT genome_id, coalesce(max(share) FILTER (base = 'A'), 0) AS a, coalesce(max(share) FILTER (base = 'C'), 0) AS c, coalesce(max(share) FILTER (base = 'G'), 0) AS g, coalesce(max(share) FILTER (base = 'T'), 0) AS t
  FROM (SELECT genome_id, base, count(*) / sum(count(*)) OVER (PARTITION BY genome_id) AS share FROM background GROUP BY genome_id, base) GROUP BY genome_id),
chances AS (SELECT genome_id, (a * t * g + g * t * g + t * t * g) / (a * t * g + g * t * g + t * t * g + (t * a * a + t * a * g + t * g * a)) AS p FROM shares),
bounds AS (SELECT genome_id, p, CASE WHEN p <= 0 THEN 0 WHEN p >= 1 THEN 101 ELSE least(101, floor(ln(1 - 0.999::DOUBLE) / ln(p))) END::INT AS i FROM chances),
priors AS (
  SELECT genome_id, p, i + 1 AS most, uf, i - uf AS df
  FROM (SELECT *, CASE WHEN p <= 0 OR p >= 1 THEN 0 ELSE p * (1 - i * pow(p, i - 1) + (i - 1) * pow(p, i)) / (1 - p) END AS uf FROM bounds)) """

POSTERIOR = """, sums AS (
  SELECT k.genome_id, k.contig_id, k.strand, k."end", k.j, sum(logp) FILTER (class = 'background') AS bg, sum(logp) FILTER (class = 'start') AS st, sum(logp) FILTER (class = 'other') AS ot
  FROM kmers k JOIN logp l ON l.genome_id = k.genome_id AND l.pos = k.pos AND l.kmer = k.kmer GROUP BY ALL),
scores AS (SELECT contig_id, strand, "end", j, round(1 / (1 + exp(bg - st) * uf + exp(ot - st) * df), 6) AS score FROM sums JOIN priors USING (genome_id) WHERE j < most) """

EARLY = """
WITH c AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS j, round(value - floor(value), 6) AS score FROM events),
t AS (SELECT user_id, coalesce(max(score) FILTER (j < 5), 0) AS best FROM c GROUP BY user_id),
r AS (SELECT c.*, best < 0.9 AS tail_scored, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, j) AS k FROM c JOIN t USING (user_id) WHERE j < 5 OR best < 0.9)
SELECT user_id, j::INT AS j, score, tail_scored FROM r WHERE k = 1"""

_SIGN = "CASE strand WHEN 1 THEN '-' ELSE '+' END"

MATCH = (
    GENES
    + f""", predicted AS (SELECT genome_id AS assembly, name AS host, rstart AS start, rend AS "end", {_SIGN} AS strand, idx AS ord, len FROM genes),
truth AS (
  SELECT assembly, host, start + CASE WHEN ord % 3 = 0 THEN 3 ELSE 0 END AS start, "end" + CASE WHEN ord % 9 = 0 THEN 6 ELSE 0 END AS "end", strand, ord FROM predicted WHERE len >= 120) """
)

#: Greedy matching, one prediction of every host a step.
GREEDY = """, candidates AS (
  SELECT p.assembly, p.host, p.len >= 150 AS good, p.ord AS p, t.ord AS t FROM predicted p JOIN truth t ON t.assembly = p.assembly AND t.host = p.host AND t.strand = p.strand AND t.start = p.start
  UNION SELECT p.assembly, p.host, p.len >= 150, p.ord, t.ord FROM predicted p JOIN truth t ON t.assembly = p.assembly AND t.host = p.host AND t.strand = p.strand AND t."end" = p."end"),
wants AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY assembly, host, good ORDER BY p) AS r FROM (SELECT assembly, host, good, p, list_sort(list(t)) AS ts FROM candidates GROUP BY ALL)),
walk AS (
  SELECT DISTINCT assembly, host, good, 0::BIGINT AS r, []::BIGINT[] AS taken FROM wants
  UNION ALL
  SELECT w.assembly, w.host, w.good, n.r, CASE WHEN len(list_filter(n.ts, lambda x: NOT list_contains(w.taken, x))) > 0 THEN list_append(w.taken, list_filter(n.ts, lambda x: NOT list_contains(w.taken, x))[1]) ELSE w.taken END
  FROM walk w JOIN wants n ON n.assembly = w.assembly AND n.host = w.host AND n.good = w.good AND n.r = w.r + 1),
matched AS (SELECT assembly, good, sum(n) AS n FROM (SELECT assembly, host, good, max(len(taken)) AS n FROM walk GROUP BY ALL) GROUP BY ALL),
counts AS (SELECT assembly, count(*) FILTER (len >= 150) AS pred, count(*) FILTER (len < 150) AS neg FROM predicted GROUP BY assembly)
SELECT c.assembly, pred, coalesce(t.n, 0)::BIGINT AS "true", coalesce(g.n, 0)::BIGINT AS true_pos, neg, coalesce(f.n, 0)::BIGINT AS false_neg
FROM counts c LEFT JOIN (SELECT assembly, count(*) AS n FROM truth GROUP BY assembly) t USING (assembly)
LEFT JOIN (SELECT * FROM matched WHERE good) g USING (assembly) LEFT JOIN (SELECT * FROM matched WHERE NOT good) f USING (assembly)"""

DRAWS = """, codon_usage AS (SELECT genome_id, codon, count(*) AS n FROM orf_codons WHERE codon NOT IN ('TAA', 'TAG', 'TGA') GROUP BY ALL),
ranges AS (SELECT genome_id, codon, sum(n) OVER w - n AS lo, sum(n) OVER w AS hi, sum(n) OVER (PARTITION BY genome_id) AS total FROM codon_usage WINDOW w AS (PARTITION BY genome_id ORDER BY codon ROWS UNBOUNDED PRECEDING)),
drawn AS (SELECT genome_id, contig_id, strand, "end", ('0x' || substr(md5(concat_ws(':', '42', genome_id, contig_id, strand, "end")), 1, 13))::BIGINT / pow(2, 52) AS u FROM complete)
SELECT d.genome_id, contig_id, strand, "end", round(u, 9) AS u, codon FROM drawn d JOIN ranges r ON r.genome_id = d.genome_id AND u * total >= lo AND u * total < hi"""

LINES = f""", lines AS (
  SELECT contig_id, idx,
         concat_ws(chr(9), name, 'helixframe', CASE WHEN i_score >= 0 THEN 'CDS' ELSE 'ORF' END, rstart, rend, printf('%.3f', round_even(t_score, 3)), {_SIGN}, '0', 'ID=' || printf('ORF%06d', idx + 1) || ';partial=' || (edge_type >= 5)::INT || (edge_type IN (3, 8))::INT || ';r_score=' || printf('%.3f', round_even(r_score, 3))) AS gff,
         concat_ws(chr(9), name, rstart - 1, rend, printf('ORF%06d', idx + 1), greatest(0, least(1000, trunc(t_score * 1000)::INT)), {_SIGN}) AS bed,
         '>' || name || ':' || rstart || '..' || rend || '(' || {_SIGN} || ') ID=' || printf('ORF%06d', idx + 1) || ';score=' || printf('%.3f', round_even(t_score, 3)) || ';paritial=' || (edge_type >= 5)::INT || (edge_type IN (3, 8))::INT AS fasta
  FROM genes) """

def _locations(of: str) -> str:
    return f""", spanned AS (
  SELECT *, CASE WHEN rstart > rend THEN 'join(' || rstart || '..' || contig_len || ',1..' || rend || ')'
    ELSE CASE WHEN CASE strand WHEN 1 THEN edge_type IN (3, 8) ELSE edge_type >= 5 END THEN '<' ELSE '' END || rstart || '..' ||
         CASE WHEN CASE strand WHEN 1 THEN edge_type >= 5 ELSE edge_type IN (3, 8) END THEN '>' ELSE '' END || rend END AS span FROM {of}),
locations AS (SELECT *, CASE strand WHEN 1 THEN 'complement(' || span || ')' ELSE span END AS location FROM spanned) """


LOCATIONS = _locations("orfs")


def _coding(code: str, stops: str) -> str:
    """The first nine features of the ORFs under a code, from their first ATG on, and whether the network takes them for coding."""
    return f"""
spans_{code} AS (
  SELECT contig_id, strand, frame, min(pos) FILTER (NOT stop)::INT AS start, max(pos) FILTER (stop)::INT + 3 AS "end"
  FROM (SELECT *, coalesce(sum(stop::INT) OVER (PARTITION BY contig_id, strand, frame ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island
        FROM (SELECT contig_id, strand, frame, pos, codon IN ({stops}) AS stop FROM marks WHERE codon IN ({stops}, 'ATG')))
  GROUP BY contig_id, strand, frame, island),
cut_{code} AS (
  SELECT row_number() OVER () AS r, genome_id, "end" - start AS len, substr(s, start + 1, "end" - start) AS nt
  FROM spans_{code} JOIN sides USING (contig_id, strand, frame) WHERE start IS NOT NULL AND "end" - start >= 90),
mono_{code} AS (
  SELECT r, genome_id, len, 3 * p + a AS k, (len(list_filter(l, lambda x: x IN (plus[1], plus[2]))) - len(list_filter(l, lambda x: x NOT IN (plus[1], plus[2]))))::DOUBLE * 3 / len AS x
  FROM (SELECT r, genome_id, len, p, regexp_extract_all(nt, '(.)(.)(.)', p + 1) AS l FROM cut_{code}, (VALUES (0), (1), (2)) t(p)), (VALUES (0, 'AG'), (1, 'AC'), (2, 'AT')) u(a, plus)),
coding_{code} AS (
  SELECT genome_id, '{code}' AS code, len, 0.5 * greatest(0, sum(CASE WHEN k % 2 = 1 THEN x ELSE -0.5 * x END) + 0.1) - greatest(0, sum(0.25 * x) - 0.2) + 0.3137 > 0 AS codes
  FROM mono_{code} GROUP BY r, genome_id, len)"""


TABLES = f"""WITH {_CONTIGS}, {_SIDES},
marks AS MATERIALIZED (
  SELECT contig_id, strand, frame, codon, frame + 3 * (i - 1) AS pos
  FROM (SELECT contig_id, strand, frame, unnest(l) AS codon, generate_subscripts(l, 1) AS i
        FROM (SELECT contig_id, strand, frame, regexp_extract_all(substr(s, frame + 1), '...') AS l FROM sides))
  WHERE codon IN ('TAA', 'TAG', 'TGA', 'ATG')),
{_coding("11", "'TAA', 'TAG', 'TGA'")}, {_coding("16", "'TAA', 'TGA'")}, {_coding("4", "'TAA', 'TAG'")},
scores AS (
  SELECT genome_id, code, round(sum(CASE WHEN codes THEN len ELSE 0 END) / sum(len), 6) AS score
  FROM (SELECT * FROM coding_11 UNION ALL SELECT * FROM coding_16 UNION ALL SELECT * FROM coding_4) GROUP BY ALL)
SELECT genome_id, code, score FROM (
  SELECT *, row_number() OVER (PARTITION BY genome_id ORDER BY score DESC, CASE code WHEN '11' THEN 0 WHEN '16' THEN 1 ELSE 2 END) AS r FROM scores) WHERE r = 1"""

MLP = """, scaled AS (SELECT contig_id, strand, "end", k, (value - mean) / CASE WHEN sd < 1e-9 THEN 1 ELSE sd END AS x FROM feats JOIN stats USING (k)),
layer AS (SELECT contig_id, strand, "end", greatest(0, sum(CASE WHEN k % 2 = 1 THEN x ELSE -0.5 * x END) / 10 + 0.1) AS a, greatest(0, sum((k % 7 - 3) * x) / 20 - 0.2) AS b, greatest(0, sum(0.25 * x) / 10) AS c FROM scaled GROUP BY ALL)
SELECT contig_id, strand, "end", round(1 / (1 + exp(-(0.5 * a - b + 0.25 * c + 0.3) / 2)), 6) AS score FROM layer"""

FEATURE_LINES = f"""{_locations("genes")},
translated AS (SELECT *, array_to_string(list_transform(regexp_extract_all(nt, '...'), lambda c: code[c]), '') AS p FROM locations, (SELECT MAP {{{_CODE}}} AS code))
SELECT contig_id, idx, md5('     ' || CASE WHEN i_score >= 0 THEN 'CDS' ELSE 'ORF' END || repeat(' ', 13) || location
  || chr(10) || repeat(' ', 21) || '/locus_tag=' || printf('ORF%06d', idx + 1)
  || chr(10) || repeat(' ', 21) || '/transl_table=11' || chr(10) || repeat(' ', 21) || '/codon_start=1'
  || chr(10) || repeat(' ', 21) || '/note="Derived by protein-coding gene prediction method: helixframe"'
  || chr(10) || repeat(' ', 21) || '/translation="' || CASE WHEN edge_type >= 5 THEN p ELSE 'M' || substr(p, 2) END || '"') AS digest
FROM translated"""
