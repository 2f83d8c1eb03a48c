"""Round-trip corpora derived from the driver tables with DataFrame expressions.

The shape of every generated function is decided by arithmetic on a key, so an
independent SQL oracle can compute the expected answer from the keys alone
while the engine has to recover it from the generated text. The corpora grow
with the scale factor of the input tables.

* ``shapes`` from ``orders``: one function per order, five per file.
* ``chains`` from ``part``: helper-call chains for call expansion.
* ``run_log`` from ``events``: test-run outputs before / after a rewrite.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

N_PROJECTS = 25
FUNCS_PER_FILE = 5
VENDOR_MOD, VENDOR_REM = 17, 16
ERROR_MOD, ERROR_REM = 19, 18
ZERO_TEST_PROJECT = 24


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shape_keys(orders: DataFrame, *keep: str) -> DataFrame:
    k = F.col("o_orderkey")
    f = F.floor(k / FUNCS_PER_FILE)
    base_v = (k + f) % 10
    proj_no = f % N_PROJECTS
    return orders.select(
        *keep,
        k.alias("k"),
        f.alias("f"),
        F.when(proj_no == ZERO_TEST_PROJECT, 5 + base_v % 5).otherwise(base_v).alias("v"),
        (F.floor(k / 10) % 7).alias("n"),
        F.format_string("proj%02d", proj_no).alias("project"),
        F.concat(F.lit("pkg"), (F.floor(f / N_PROJECTS) % 4).cast("string")).alias("package"),
    )


def _rows(template: str) -> str:
    """SQL text: ``s.n`` scenario rows built from ``template`` (``@i@`` = row index)."""
    body = template.replace("@i@", "', cast(i AS string), '")
    return ("CASE WHEN s.n > 0 THEN concat(array_join(transform(sequence(0, s.n - 1), "
            "i -> concat('" + body + "')), '\\n'), '\\n') ELSE '' END")


_STRUCT_ROW = '\\t\\t{"s{@i@", 1}, // }'
_MAP_ROW = '\\t\\t"s{@i@": {1},'

# Text of each function shape of a struct `s`; `k` is the key, `n` the scenario count.
_FUNC_SQL = """
CASE s.v
 WHEN 0 THEN concat('func TestK', s.k, '(t *testing.T) {\\n',
   '\\ttests := []struct {\\n\\t\\tname string\\n\\t\\twant int\\n\\t}{\\n',
   @STRUCT_ROWS@,
   '\\t}\\n\\tfor _, tt := range tests {\\n\\t\\tt.Log(tt.name, tt.want)\\n\\t}\\n}')
 WHEN 1 THEN concat('func TestK', s.k, '(t *testing.T) {\\n',
   '\\ttests := []struct {\\n\\t\\tname string\\n\\t\\twant int\\n\\t}{\\n',
   @STRUCT_ROWS@,
   '\\t}\\n\\tfor _, tt := range tests {\\n',
   '\\t\\tt.Run(tt.name, func(t *testing.T) {\\n\\t\\t\\tt.Log(tt.want)\\n\\t\\t})\\n\\t}\\n}')
 WHEN 2 THEN concat('func TestK', s.k, '(t *testing.T) {\\n',
   '\\ttests := map[string]struct {\\n\\t\\twant int\\n\\t}{\\n',
   @MAP_ROWS@,
   '\\t}\\n\\tfor name, tt := range tests {\\n\\t\\tt.Log(name, tt.want)\\n\\t}\\n}')
 WHEN 3 THEN concat('func TestK', s.k, '(t *testing.T) {\\n\\tt.Log("}")\\n}')
 WHEN 4 THEN concat('func Test_', s.k, '(t *testing.T) {\\n\\tt.Skip()\\n}')
 WHEN 5 THEN concat('func helper', s.k, '(t *testing.T) {\\n\\tt.Helper()\\n}')
 WHEN 6 THEN concat('func (s *S) TestK', s.k, '(t *testing.T) {\\n}')
 WHEN 7 THEN concat('func TestK', s.k, '(t *testing.T, x int) {\\n}')
 WHEN 8 THEN concat('func TestK', s.k, '(t *testing.T) error {\\n\\treturn nil\\n}')
 ELSE concat('func TestK', s.k, '(m *testing.M) {\\n}')
END
""".replace("@STRUCT_ROWS@", _rows(_STRUCT_ROW)).replace("@MAP_ROWS@", _rows(_MAP_ROW))


def _shape_path():
    vendored = (F.col("f") % VENDOR_MOD) == VENDOR_REM
    return F.concat(
        F.lit("/src/"), F.col("project"), F.lit("/"),
        F.when(vendored, F.lit("vendor/")).otherwise(F.lit("")),
        F.col("package"), F.lit("/f"), F.col("f").cast("string"),
        F.when(F.col("f") % 3 == 0, F.lit(".go")).otherwise(F.lit("_test.go")),
    )


def _shape_name():
    k = F.col("k").cast("string")
    return (F.when(F.col("v") == 4, F.concat(F.lit("Test_"), k))
            .when(F.col("v") == 5, F.concat(F.lit("helper"), k))
            .otherwise(F.concat(F.lit("TestK"), k)))


def shape_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One generated function per order: its keys."""
    keys = _shape_keys(_table(spark, sf_dir, "orders").select("o_orderkey"))
    return keys.withColumn("path", _shape_path())


#: Functions whose keys one task groups into files. A table of keys is read by few tasks, as it
#: is small; their texts are not.
FUNCS_PER_TASK = 50_000


def _dealt(keys: DataFrame, by: str) -> DataFrame:
    """The keys in tasks of ``FUNCS_PER_TASK``, however few row groups the table has."""
    return keys.repartition(max(1, -(-keys.count() // FUNCS_PER_TASK)), by)


def shape_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``source_file(project, path, content)``: five functions per file.

    Assembled with one bounded group per file (at most five rows each). The keys are dealt by
    file number before anything is made of them: names and texts are not the work of the few
    tasks that read the table.
    """
    orders = _table(spark, sf_dir, "orders").select("o_orderkey")
    dealt = _dealt(orders.withColumn("file", F.floor(F.col("o_orderkey") / FUNCS_PER_FILE)), "file")
    funcs = _shape_keys(dealt, "file").withColumn("path", _shape_path())
    grouped = funcs.groupBy("file", "project", "path").agg(
        F.first("package").alias("package"), F.array_sort(F.collect_list(F.struct("k", "v", "n"))).alias("fs"))
    header = F.concat(F.lit("package "), F.col("package"),
                      F.lit('\n\nimport (\n\t"testing"\n\tstr "strings"\n)\n\n'))
    body = F.array_join(F.expr(f"transform(fs, s -> {_FUNC_SQL})"), "\n\n")
    content = F.concat(header, body, F.lit("\n\n// trailing }\n"))
    return grouped.select("project", "path", content.alias("content"))


def shape_load_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``load_error(project, position, message)`` for every file with f % 19 = 18,
    plus error rows without a usable position (no colon, or colon first), which
    must not exclude anything."""
    files = shape_functions(spark, sf_dir).select("project", "path", "f").distinct()
    bad = files.filter(F.col("f") % ERROR_MOD == ERROR_REM)
    real = bad.select("project", F.concat(F.col("path"), F.lit(":3:2")).alias("position"),
                      F.lit("undefined: str.Missing").alias("message"))
    no_pos = bad.select("project", F.lit("-").alias("position"),
                        F.lit("package has errors").alias("message"))
    colon_first = bad.select("project", F.concat(F.lit(":"), F.col("path")).alias("position"),
                             F.lit("malformed position").alias("message"))
    return real.unionByName(no_pos).unionByName(colon_first)


# ---------------------------------------------------------------- chains

N_CHAIN_PKGS = 50


def chain_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file per part: ``TestC<p>`` and a chain of ``L = p % 6`` helpers.

    Helper ``h<p>_i`` calls ``h<p>_<i+1>``; the last calls ``h<p>_0`` when
    ``p % 4 = 0`` (a cycle) and ``t.Log()`` otherwise.
    """
    p = F.col("p_partkey")
    parts = _dealt(_table(spark, sf_dir, "part").select(p.alias("p")), "p")
    L = F.col("p") % 6
    ps = F.col("p").cast("string")
    test_body = F.when(L >= 1, F.concat(F.lit("\th"), ps, F.lit("_0(t)"))).otherwise(F.lit("\tt.Log()"))
    test_fn = F.concat(F.lit("func TestC"), ps, F.lit("(t *testing.T) {\n"), test_body, F.lit("\n}"))

    def helper(i):
        last = i == L - 1
        call = F.when(last & (F.col("p") % 4 == 0), F.concat(F.lit("h"), ps, F.lit("_0(t)"))) \
            .when(last, F.lit("t.Log()")) \
            .otherwise(F.concat(F.lit("h"), ps, F.lit("_"), (i + 1).cast("string"), F.lit("(t)")))
        return F.concat(F.lit("func h"), ps, F.lit("_"), i.cast("string"),
                        F.lit("(t *testing.T) {\n\t"), call, F.lit("\n}"))

    helpers = F.transform(F.sequence(F.lit(0), F.greatest(L - 1, F.lit(0))), lambda i: helper(i))
    helpers = F.when(L >= 1, helpers).otherwise(F.array().cast("array<string>"))
    pkg = F.concat(F.lit("pkg"), (F.col("p") % N_CHAIN_PKGS).cast("string"))
    content = F.concat(
        F.lit("package "), pkg, F.lit('\n\nimport "testing"\n\n'),
        F.array_join(F.concat(F.array(test_fn), helpers), "\n\n"), F.lit("\n"))
    return parts.select(
        F.lit("chain").alias("project"),
        F.concat(F.lit("/src/chain/"), pkg, F.lit("/c"), ps, F.lit("_test.go")).alias("path"),
        content.alias("content"))


# ---------------------------------------------------------------- run logs

# Fixed mapping of event types to captured `go test` output.
RUN_OUTPUT = {
    "error": ("=== RUN   TestX\n--- FAIL: TestX (0.00s)\nFAIL", False),
    "signup": ("# pkg [build failed]\nFAIL", False),
    "click": ("=== RUN   TestX\n--- SKIP: TestX (0.00s)\nPASS", True),
    "view": ("testing: warning: no tests to run\nPASS", True),
    "purchase": ("=== RUN   TestX\n--- PASS: TestX (0.00s)\nPASS", True),
}


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``run_log`` derived from ``events``: test_id = event_id div 2, even events
    are the original run, odd ones the run after the rewrite; stderr is NULL on
    every third event."""
    ev = _table(spark, sf_dir, "events").select("event_id", "event_type")
    out = F.lit(None).cast("string")
    ok = F.lit(None).cast("boolean")
    eid = F.col("event_id")
    keyed = _shape_keys(ev.withColumn("o_orderkey", F.floor(eid / 2)), "event_id", "event_type")
    ev = keyed.select("event_id", "event_type", "project", _shape_path().alias("path"),
                      _shape_name().alias("test"))
    for et, (text, exit_ok) in RUN_OUTPUT.items():
        out = F.when(F.col("event_type") == et, F.lit(text)).otherwise(out)
        ok = F.when(F.col("event_type") == et, F.lit(exit_ok)).otherwise(ok)
    # The run of event e is a run of the generated function k = e div 2, so run
    # logs join the round-trip corpus on (project, path, test name).
    test_id = F.floor(eid / 2)
    return ev.select(
        eid.alias("run_id"),
        test_id.alias("test_id"),
        "project",
        "path",
        "test",
        F.when(eid % 2 == 0, F.lit("original")).otherwise(F.lit("refactored")).alias("phase"),
        ok.alias("exit_ok"),
        out.alias("output"),
        F.when(eid % 3 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("exit status 1: "), F.col("event_type"))).alias("stderr"),
    )


# ---------------------------------------------------------------- enum texts

# Fixed raw enum texts per event type: (execution result, generation status,
# refactor strategy) as they could appear in JSON written by other tools.
ENUM_TEXTS = {
    "error": ("Fail", "BadFields", "SubTest"),
    "signup": ("compilationerror", "NOTESTER", "none"),
    "click": ("SKIP", "success", "SUBTEST"),
    "view": ("NotRun", "Error", "other"),
    "purchase": ("passed", "weird", " subtest "),
}


def enum_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(event_id, raw_result, raw_status, raw_strategy)`` from ``events``."""
    ev = _table(spark, sf_dir, "events").select("event_id", "event_type")
    cols = []
    for i, name in enumerate(["raw_result", "raw_status", "raw_strategy"]):
        c = F.lit(None).cast("string")
        for et, texts in ENUM_TEXTS.items():
            c = F.when(F.col("event_type") == et, F.lit(texts[i])).otherwise(c)
        cols.append(c.alias(name))
    return ev.select("event_id", *cols)


# Fixed extension per doc_id % 5.
DOC_EXTENSIONS = ["txt", "CSV", "json", "md", None]


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, file_name)`` from ``documents``: ``<source>.<ext>``."""
    d = _table(spark, sf_dir, "documents").select("doc_id", "source")
    ext = F.lit(None).cast("string")
    for i, e in enumerate(DOC_EXTENSIONS):
        if e is not None:
            ext = F.when(F.col("doc_id") % 5 == i, F.lit(e)).otherwise(ext)
    name = F.when(ext.isNull(), F.col("source")).otherwise(F.concat(F.col("source"), F.lit("."), ext))
    return d.select("doc_id", name.alias("file_name"))


# ---------------------------------------------------------------- calls and their owners

N_OWNER_PKGS = 40


def _text(template: str, **parts) -> F.Column:
    """Column of a template: ``@name@`` stands for the column ``parts[name]``."""
    pieces = template.split("@")
    return F.concat(*[F.lit(p) if i % 2 == 0 else parts[p].cast("string") for i, p in enumerate(pieces)])


# Bodies of the eight shapes of the owner corpus (`c`: the key, `g`: its group of eight).
_OWNER_SHAPES = [
    "type R@c@ struct {\n\tx int\n}\n\nfunc (r *R@c@) Println(n int) {\n\t_ = n\n}\n\n"
    "func dup@g@(t *testing.T) {\n\tt.Log()\n}\n\nfunc TestO@c@(t *testing.T) {\n\tfmt.Println(@c@)\n}",
    "func TestO@c@(t *testing.T) {\n\ttwin@g@(t)\n}\n\nfunc twin@g@(t *testing.T) {\n\tt.Helper()\n}",
    "func TestO@c@(t *testing.T) {\n\ttwin@g@(t)\n}\n\nfunc twin@g@(t *testing.T) {\n\tt.Helper()\n\tt.Log()\n}",
    "type A@c@ struct {\n\tn int\n}\n\ntype B@c@ struct {\n\tn int\n}\n\nfunc (a A@c@) Do@c@() {\n\t_ = a\n}\n\n"
    "func (b *B@c@) Do@c@() {\n\t_ = b\n\t_ = b.n\n}\n\nfunc TestO@c@(t *testing.T) {\n\tx := &B@c@{n: 1}\n\tx.Do@c@()\n}",
    "type In@c@ struct {\n\tn int\n}\n\nfunc (i *In@c@) Deep@c@() {\n\t_ = i\n}\n\ntype Out@c@ struct {\n\tIn@c@\n\tf In@c@\n}\n\n"
    "func TestO@c@(t *testing.T) {\n\tvar o Out@c@\n\to.Deep@c@()\n\to.f.Deep@c@()\n}",
    "type S@c@ struct {\n\tn int\n}\n\nfunc New@c@() *S@c@ {\n\treturn nil\n}\n\nfunc (s *S@c@) With@c@(n int) *S@c@ {\n\treturn s\n}\n\n"
    "func TestO@c@(t *testing.T) {\n\tNew@c@().With@c@(1).With@c@(2)\n}",
    "func hid@c@(t *testing.T) {\n\tt.Helper()\n}\n\nfunc TestO@c@(t *testing.T) {\n\thid@c@ := func(t *testing.T) {}\n\thid@c@(t)\n}",
    "func TestO@c@(t *testing.T) {\n\tdup@g@(t)\n}\n\nfunc dup@g@(t *testing.T) {\n\tt.Helper()\n}",
]


def owner_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file for each customer: what a call belongs to, in the eight ways of
    ``_OWNER_SHAPES``; shape 1 is in the ``_test`` package of its folder."""
    rows = _dealt(_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("c")), "c").withColumn("g", F.floor(F.col("c") / 8))
    pkg = (F.col("g") % N_OWNER_PKGS).cast("string")
    body = F.lit(None).cast("string")
    for i, shape in enumerate(_OWNER_SHAPES):
        body = F.when(F.col("c") % 8 == i, _text(shape, c=F.col("c"), g=F.col("g"))).otherwise(body)
    head = F.concat(F.lit("package own"), pkg, F.when(F.col("c") % 8 == 1, F.lit("_test")).otherwise(F.lit("")),
                    F.lit('\n\nimport (\n\t"fmt"\n\t"testing"\n)\n\n'))
    return rows.select(F.lit("own").alias("project"), F.concat(F.lit("/src/own/pkg"), pkg, F.lit("/o"), F.col("c").cast("string"), F.lit("_test.go")).alias("path"),
                       F.concat(head, body, F.lit("\n")).alias("content"))


# ---------------------------------------------------------------- where scenarios stand

# Bodies of the eight shapes of the table corpus; `@rows@` are n scenarios, `@more@` n + 1.
_TABLE_SHAPES = [
    "func TestT@c@(t *testing.T) {\n\tfor _, tt := range []row@c@{\n@rows@\t} {\n\t\tt.Log(tt.name)\n\t}\n}\n\n"
    "func TestN@c@(t *testing.T) {\n\tt.Skip()\n}",
    "func TestT@c@(t *testing.T) {\n\ttests := []row@c@{\n@rows@\t}\n\tfor _, tt := range tests {\n\t\tt.Log(tt.name)\n\t}\n}",
    "func TestT@c@(t *testing.T) {\n\ttests := build@c@()\n\tfor _, tt := range tests {\n\t\tt.Log(tt.name)\n\t}\n}\n\n"
    "func build@c@() []row@c@ {\n\trows := []row@c@{\n@rows@\t}\n\treturn rows\n}",
    "var cases@c@ = []row@c@{\n@rows@}\n\nfunc TestT@c@(t *testing.T) {\n\tfor _, tt := range cases@c@ {\n\t\tt.Log(tt.name)\n\t}\n}",
    "func (s *suite@c@) cases() []row@c@ {\n\treturn []row@c@{\n@rows@\t}\n}\n\nfunc TestT@c@(t *testing.T) {\n\ts := &suite@c@{}\n"
    "\tfor _, tt := range s.@member@ {\n\t\tt.Log(tt.name)\n\t}\n}",
    "func TestT@c@(t *testing.T) {\n\tfor _, tt := range ext.Cases() {\n\t\tt.Log(tt)\n\t}\n}",
    "func TestT@c@(t *testing.T) {\n\ttests := []row@c@{\n@rows@\t}\n\tsetup@c@(t)\n\tfor _, tt := range tests {\n\t\tt.Log(tt.name)\n\t}\n}\n\n"
    "func setup@c@(t *testing.T) {\n\tt.Helper()\n\textra := []row@c@{\n@more@\t}\n\t_ = extra\n}",
    "func TestT@c@(t *testing.T) {\n\tbase := build@c@()\n\tall := append(base, base[0])\n\tfor _, tt := range all[1:] {\n\t\tt.Log(tt.name)\n\t}\n}\n\n"
    "func build@c@() (rows []row@c@) {\n\trows = []row@c@{\n@rows@\t}\n\treturn\n}",
]


def table_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file for each customer: a table-driven test whose scenarios stand where the shape
    ``c % 8`` puts them, ``(c div 8) % 5`` of them."""
    c, g = F.col("c"), F.col("g")
    rows = _dealt(_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("c")), "c").withColumn("g", F.floor(c / 8))
    n = g % 5

    def scenarios(count, letter):
        each = F.transform(F.sequence(F.lit(1), count), lambda i: F.concat(F.lit(f'\t\t{{"{letter}'), (i % 10).cast("string"), F.lit('", 1},\n')))
        return F.when(count > 0, F.array_join(each, "")).otherwise(F.lit(""))
    parts = {"c": c, "rows": scenarios(n.cast("int"), "a"), "more": scenarios((n + 1).cast("int"), "long"),
             "member": F.when(g % 2 == 0, F.lit("cases()")).otherwise(F.lit("rows"))}
    body = F.lit(None).cast("string")
    for i, shape in enumerate(_TABLE_SHAPES):
        body = F.when(c % 8 == i, _text(shape, **parts)).otherwise(body)
    pkg = (g % N_OWNER_PKGS).cast("string")
    head = F.concat(F.lit("package tab"), pkg, F.lit('\n\nimport (\n\text "example.com/x/ext/v2"\n\t"testing"\n)\n\n'),
                    _text("type row@c@ struct {\n\tname string\n\twant int\n}\n\ntype suite@c@ struct {\n\trows []row@c@\n}\n\n", c=c))
    return rows.select(F.lit("tab").alias("project"), F.concat(F.lit("/src/tab/pkg"), pkg, F.lit("/t"), c.cast("string"), F.lit("_test.go")).alias("path"),
                       F.concat(head, body, F.lit("\n")).alias("content"))


# ---------------------------------------------------------------- messages with positions

def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(project, message)`` for each line item: a message that names a line of the file of
    order ``l_orderkey``, as a failing test or a load error prints it."""
    li = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    keyed = _shape_keys(li, "l_linenumber")
    line = 1 + (F.col("l_linenumber") * 7 + F.col("k")) % 70
    return keyed.select("project", F.concat(F.lit("    "), _shape_path(), F.lit(":"), line.cast("string"), F.lit(":3: got 1, want 2")).alias("message"))


# ---------------------------------------------------------------- packed statements

# Bodies of the five shapes of the packed corpus.
_PACKED_SHAPES = [
    "func TestP@c@(t *testing.T) {\n\ta := 1; b := 2\n\t_ = a + b\n}",
    'func TestP@c@(t *testing.T) {\n\ttests := []struct{ name string }{ {"a;"}, {"b"} }\n'
    "\tfor _, tt := range tests { t.Run(tt.name, func(t *testing.T) { t.Log(tt.name); t.Log(1) }) }\n}",
    "func TestP@c@(t *testing.T) {\n\tfor i := 0; i < 3; i++ { t.Log(i); t.Log(i) }\n"
    "\tif x := 1; x > 0 { t.Log(x) } else if y := x; y > 0 { t.Log(y) }\n"
    "\tswitch z := 2; z {\n\tcase 1:\n\t\tt.Log(z); t.Log(z)\n\t}\n}",
    'func TestP@c@(t *testing.T) {\n\ttests := map[string]int{"a": 1}\n\tfor name, want := range tests {\n'
    "\t\t_ = want; t.Run(name, func(t *testing.T) {})\n\t}\n}",
    "func TestP@c@(t *testing.T) { a := 1; t.Log(a); t.Skip() }",
]


def packed_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file for each customer with a test of the shape ``c % 5``."""
    c = F.col("c")
    rows = _dealt(_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("c")), "c")
    body = F.lit(None).cast("string")
    for i, shape in enumerate(_PACKED_SHAPES):
        body = F.when(c % 5 == i, _text(shape, c=c)).otherwise(body)
    return rows.select(F.lit("packed").alias("project"), F.concat(F.lit("/src/packed/pkg"), (c % N_OWNER_PKGS).cast("string"), F.lit("/p"), c.cast("string"), F.lit("_test.go")).alias("path"),
                       F.concat(F.lit('package packed\n\nimport "testing"\n\n'), body, F.lit("\n")).alias("content"))
