"""Unit tables replaying the reference's own cases for the text functions."""

from pyspark.sql import functions as F

from gradewell.functions import text as T
from conftest import one

VM = 'resource "xenorchestra_vm" "vm" {}'


def ext(spark, s):
    return one(spark, T.extract_code(F.col("x")), s)


def test_extract_tag_only_block_is_empty(spark):
    assert ext(spark, "```hcl```") == ""


def test_extract_tagged_block(spark):
    assert ext(spark, '```hcl\nresource "x" "y" {}\n```') == 'resource "x" "y" {}'


def test_extract_tf_and_untagged(spark):
    for tag in ("tf", "TF", ""):
        assert ext(spark, f"```{tag}\n{VM}\n```") == VM


def test_extract_unclosed(spark):
    r = ext(spark, f"```hcl\n{VM}")
    assert r == VM


def test_extract_last_block(spark):
    a = 'resource "xenorchestra_vm" "build_01" { name_label = "build-01" }'
    b = 'resource "xenorchestra_vm" "app_01" { name_label = "app-01" }'
    r = ext(spark, f"Here:\n```hcl\n{a}\n```\n\nAnswer:\n```hcl\n{b}\n```")
    assert r == b


def test_extract_keeps_terraform_keyword(spark):
    r = ext(spark, "```\nterraform {\n  required_providers {}\n}\n```")
    assert r.startswith("terraform {")


def test_extract_blank_line_before_tag(spark):
    assert ext(spark, f"```\nhcl\n{VM}\n```") == VM


def test_extract_crlf(spark):
    assert ext(spark, f"```hcl\r\n{VM}\r\n```") == VM


def test_extract_prose_and_null(spark):
    assert ext(spark, "I cannot generate Terraform code for this task.") == ""
    assert ext(spark, None) == ""


def test_extract_unfenced_code_and_long_prose(spark):
    assert ext(spark, f"  {VM}  ") == VM
    long = " ".join(["word"] * 120) + " " + VM
    assert ext(spark, long) == ""
    assert ext(spark, "terraform " + long) == "terraform " + long


def test_redact_four_hits(spark):
    raw = ('provider "xenorchestra" { username = "admin@admin.net" password = "supersecret" '
           "api_key: sk-abc token=xyz }")
    r = one(spark, T.redact(F.col("x")), raw)
    for secret in ("admin@admin.net", "supersecret", "sk-abc", "xyz"):
        assert secret not in r
    assert 'token="[REDACTED]"' in r
    assert r.count("[REDACTED]") == 4


def test_redact_colon_form_and_idempotent(spark):
    r = one(spark, T.redact(F.col("x")), "Provider username: admin@admin.net password: admin")
    assert "admin@admin.net" not in r and "password: admin" not in r
    assert one(spark, T.redact(F.col("x")), r) == r


def test_redact_messages_leaves_input(spark):
    df = spark.createDataFrame(
        [([("system", 'username="admin" password="pw"'), ("user", "Generate terraform")],)],
        "m array<struct<role string, content string>>",
    )
    row = df.select("m", T.redact_messages("m").alias("r")).first()
    assert "admin" in row["m"][0]["content"]
    assert "admin" not in row["r"][0]["content"]
    assert row["r"][1]["content"] == "Generate terraform"


def test_verdict(spark):
    cases = {
        "Final assessment: incorrect": "Incorrect",
        "blah\nRating: correct": "Correct",
        "RATING:   INCORRECT because": "Incorrect",
        "it is correct": "Correct",
        "": "Unknown",
        None: "Unknown",
        "no idea": "Unknown",
    }
    for k, v in cases.items():
        assert one(spark, T.parse_verdict(F.col("x")), k) == v, k


def test_ansi_and_truncation(spark):
    assert one(spark, T.strip_ansi(F.col("x")), "\x1b[31mred\x1b[0m") == "red"
    s = "a" * 2500 + "b" * 2500
    r = one(spark, T.truncate_middle(F.col("x"), T.TRUNCATE_MAX), s)
    assert r == "a" * 2000 + "\n... [TRUNCATED] ...\n" + "b" * 2000
    assert one(spark, T.truncate_middle(F.col("x"), 9), "short") == "short"
    assert one(spark, T.truncate_middle(F.col("x")), s) == s  # no limit unless given


def test_complexity_pieces(spark):
    hcl = ('data "xenorchestra_pool" "pool" {}\n\nresource "xenorchestra_vm" "vm" {\n'
           '  name_label = "a"\n  template = data.xenorchestra_template.t.id\n}\n')
    df = spark.createDataFrame([(hcl,)], "x string")
    r = df.select(
        T.nonblank_lines("x").alias("loc"),
        T.resource_count("x").alias("res"),
        T.interconnections("x").alias("inter"),
        T.block_types("x").alias("types"),
    ).first()
    assert (r.loc, r.res, r.inter) == (5, 2, 0)
    assert r.types == ["xenorchestra_pool", "xenorchestra_vm"]
    lv = spark.createDataFrame([(5, 1, 1), (15, 3, 3), (100, 1, 1), (5, 1, -1)], "a int, b int, c int")
    assert [x[0] for x in lv.select(T.difficulty("a", "b", "c")).collect()] == ["1", "2", "6", "1"]


def test_setting_total_reference_quirk(spark):
    code = "  cpus = 2\n  memory_max = 4294967296\n  size = 10 * 1024 * 1024 * 1024\n  cpus = 12\n"
    df = spark.createDataFrame([(code,)], "x string")
    r = df.select(
        T.setting_total("x", "cpus").alias("c"),
        T.setting_total("x", "memory_max").alias("m"),
        T.setting_total("x", "size").alias("s"),
        T.setting_total("x", "cpus", "integers").alias("ci"),
        T.setting_total("x", "memory_max", "integers").alias("mi"),
    ).first()
    assert r.c == 2 and r.m is None and r.s == 10 * 1024**3
    assert r.ci == 14 and r.mi == 4294967296


def test_eval_arith(spark):
    df = spark.createDataFrame([("2 + 3 * 4",), ("10 - 2 * 3",), ("1 2 * 3",), ("007",)], "x string")
    assert [r[0] for r in df.select(T.eval_arith("x")).collect()] == [14, 4, None, 7]


def test_alternatives_and_label(spark):
    r = one(spark, T.alternatives(F.col("x")), "Try 2 VMs with 4gb or **3 VMs** with 2.5 MB")
    assert r == ["2 VMs with 4GB each", "3 VMs with 2.5MB each"]
    assert one(spark, T.clean_label(F.col("x")), "  C1.3 / u1.2!! ") == "C1_3_u1_2"
