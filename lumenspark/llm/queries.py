"""Queries of the training-data problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenspark.llm import consensus, cutoff, leaks, packing, pairs, residue, similar
from lumenspark.plans.registry import Registry
from lumenspark.sources.tables import table

registry = Registry()


@registry.add("p1_found")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.defective_pairs(table(spark, sf_dir, "tutor_conversations"))


@registry.add("p1_report")
def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.defect_report(table(spark, sf_dir, "tutor_conversations"))


@registry.add("p9_found")
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue_documents(table(spark, sf_dir, "documents"))


@registry.add("p9_messages")
def p9_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.recurring_messages(table(spark, sf_dir, "documents"))


@registry.add("p9_report")
def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue_report(table(spark, sf_dir, "documents"))


def _explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cutoff.explanation_texts(table(spark, sf_dir, "generated_question"), table(spark, sf_dir, "qbank_amboss_openai_evaluated"))


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda name: table(spark, sf_dir, name).select("question_id", "question")
    return read("generated_question").unionByName(read("qbank_amboss_openai_evaluated"))


@registry.add("p4_found")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cutoff.cut_texts(_explanations(spark, sf_dir))


@registry.add("p4_report")
def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cutoff.cut_report(_explanations(spark, sf_dir))


@registry.add("p8_found")
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


@registry.add("p8_report")
def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leak_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


@registry.add("p8_reparameterised")
def p8_reparameterised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.reparameterised(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


@registry.add("p3_found")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.labels(table(spark, sf_dir, "human_evaluation")).select("question_id", "dimension", "label")


@registry.add("p3_reliability")
def p3_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.reliability(table(spark, sf_dir, "human_evaluation"))


@registry.add("p3_agreement")
def p3_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.agreement(table(spark, sf_dir, "human_evaluation"))


@registry.add("p5_found")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.similar_pairs(_questions(spark, sf_dir))


@registry.add("p5_groups")
def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.groups(_questions(spark, sf_dir))


@registry.add("p7_windows")
def p7_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "context_budgets"))


@registry.add("p7_fill")
def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(p7_windows(spark, sf_dir))
