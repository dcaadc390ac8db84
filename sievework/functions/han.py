"""Romanisation of Han text by a dictionary of words, and title similarity across scripts.

The dictionary is a table (char, pinyin) whose entries are characters or words of several; DICTIONARY is a small
one of the library's own. A text is read from left to right, always by the longest entry that begins where the
last one ended, as in a trie: its levels are the prefixes of the entries, and places of the texts are joined to
one level after the other as long as they match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import HAN, jaccard, title_tokens

#: Common characters and surnames, and words in which a character is read in another way.
DICTIONARY = """
一 yi, 二 er, 三 san, 中 zhong, 国 guo, 人 ren, 大 da, 学 xue, 研 yan, 究 jiu, 医 yi, 院 yuan, 北 bei, 京 jing, 上 shang, 海 hai,
重 zhong, 庆 qing, 重庆 chong qing, 长 chang, 城 cheng, 成 cheng, 都 dou, 成都 cheng du, 银 yin, 行 xing, 银行 yin hang, 行业 hang ye, 业 ye,
音 yin, 乐 le, 音乐 yin yue, 校 xiao, 校长 xiao zhang, 细 xi, 胞 bao, 基 ji, 因 yin, 数 shu, 据 ju, 分 fen, 析 xi, 方 fang, 法 fa, 应 ying, 用 yong,
系 xi, 统 tong, 网 wang, 络 luo, 模 mo, 型 xing, 信 xin, 息 xi, 技 ji, 术 shu, 王 wang, 李 li, 张 zhang, 刘 liu, 陈 chen, 杨 yang, 黄 huang,
赵 zhao, 周 zhou, 吴 wu, 徐 xu, 孙 sun, 马 ma, 朱 zhu, 胡 hu, 林 lin, 郭 guo, 何 he, 高 gao, 梁 liang, 郑 zheng, 罗 luo, 宋 song, 谢 xie, 唐 tang
"""


def dictionary(spark: SparkSession) -> DataFrame:
    """(char, pinyin) of the small dictionary."""
    rows = [tuple(x.split(" ", 1)) for x in DICTIONARY.replace("\n", " ").strip().split(", ")]
    return spark.createDataFrame(rows, "char string, pinyin string")


def matches(rows: DataFrame, key: str, text: str, words: DataFrame) -> DataFrame:
    """(key, at, char, size, pinyin): each place of a text with Han characters, and its longest entry (size 1 and null where there is none)."""
    levels = words.select("char", "pinyin", F.length("char").alias("n")).where("char != ''")
    depth = levels.agg(F.max("n").alias("n")).first()["n"] or 0
    chars = rows.where(F.col(text).rlike(HAN)).select(F.col(key), F.split(text, "").alias("_chars"))
    open_ = chars.select(key, "_chars", F.posexplode("_chars").alias("at", "char")).withColumns({"_path": F.lit(""), "_found": F.lit(None).cast("struct<size: int, pinyin: string>")})
    done = None
    for k in range(1, depth + 1):
        level = levels.where(F.col("n") >= k).groupBy(F.substring("char", 1, k).alias("_prefix")).agg(F.max(F.when(F.col("n") == k, F.col("pinyin"))).alias("_pinyin"))
        step = open_.withColumn("_path", F.concat("_path", F.coalesce(F.get("_chars", F.col("at") + (k - 1)), F.lit("")))).where(F.length("_path") == k) if k > 1 else open_.withColumn("_path", F.col("char"))
        met = step.join(level, F.col("_path") == F.col("_prefix"), "left")
        found = F.when(F.col("_pinyin").isNotNull(), F.struct(F.lit(k).alias("size"), F.col("_pinyin").alias("pinyin"))).otherwise(F.col("_found"))
        here = met.withColumn("_found", found)
        told = here.select(key, "at", "char", "_found")
        done = told if done is None else done.unionByName(told)
        open_ = here.where(F.col("_prefix").isNotNull()).drop("_prefix", "_pinyin")
    if done is None:
        done = open_.select(key, "at", "char", "_found")
    best = done.groupBy(key, "at").agg(F.first("char").alias("char"), F.max("_found").alias("_found"))
    return best.select(key, "at", "char", F.coalesce(F.col("_found.size"), F.lit(1)).alias("size"), F.col("_found.pinyin").alias("pinyin"))


def romanize(rows: DataFrame, key: str, text: str, words: DataFrame, name: str = "pinyin") -> DataFrame:
    """(key, name): toneless lower-case pinyin of each text, syllables apart; empty without Han characters.

    Characters that no entry covers stay, in lower case. Keys must be unique; a null text is empty.
    """
    held = matches(rows, key, text, words).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "char", "size", "pinyin"))).alias("_m"))
    start = F.struct(F.lit(0).alias("next"), F.array().cast("array<string>").alias("parts"))

    def step(state: Column, m: Column) -> Column:
        part = F.when(m["pinyin"].isNotNull(), F.concat(F.lit(" "), F.lower(m["pinyin"]), F.lit(" "))).otherwise(F.lower(m["char"]))
        taken = F.struct((m["at"] + m["size"]).alias("next"), F.concat(state["parts"], F.array(part)).alias("parts"))
        return F.when(m["at"] >= state["next"], taken).otherwise(state)

    read = F.aggregate("_m", start, step, lambda state: F.trim(F.regexp_replace(F.array_join(state["parts"], ""), r"\s+", " ")))
    return rows.select(key).join(held.select(key, read.alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit("")))


def title_similarity(record_title: Column, ref_title: Column, ref_pinyin: Column, record_pinyin: Column) -> Column:
    """Token similarity; between a Han and a Latin title by their romanised forms."""
    han = lambda c: c.rlike(HAN)
    plain = jaccard(title_tokens(ref_title), title_tokens(record_title))
    left = F.when(han(ref_title), ref_pinyin).otherwise(ref_title)
    right = F.when(han(record_title), record_pinyin).otherwise(record_title)
    return F.when(han(ref_title) != han(record_title), jaccard(title_tokens(left), title_tokens(right))).otherwise(plain)
