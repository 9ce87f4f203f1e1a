"""The row-wise functions F1-F28 applied to the sales orders, one column each."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from dealbook import functions as D


def scalar_battery(orders: DataFrame) -> DataFrame:
    notice = D.try_date("notice_date_txt")
    file_like = F.concat(F.coalesce("sale_type", F.lit("")), F.lit("_MM"),
                         D.zero_pad(F.col("order_id") % 14, 2), F.lit("1997_v"), F.lit(".XlSx"))
    return orders.select(
        "order_id",
        notice.alias("f01_notice_date"),
        F.year(notice).alias("f02_year"),
        F.month(notice).alias("f02_month"),
        F.coalesce("salesperson", F.lit("Sin asignar")).alias("f03_label"),
        D.round_half_away(F.col("gp3").cast("double") / F.lit(7.0), 2).alias("f04_round"),
        F.abs(F.col("gp3")).cast("double").alias("f05_abs"),
        D.to_int(F.col("order_id") % 1000).alias("f06_int"),
        D.safe_pct("gp1", "gp2").alias("f07_pct"),
        D.variance_pct(F.col("gp1") - F.col("gp3"), "gp2").alias("f08_var"),
        D.share_pct(F.col("order_id") % 10, F.lit(7)).alias("f09_share"),
        F.get(D.file_name_parts(file_like), 0).alias("f11_company"),
        F.get(D.file_name_parts(file_like), 1).alias("f11_date"),
        D.try_number(F.substring(F.get(D.file_name_parts(file_like), 1), 3, 2), "int").alias("f12_month"),
        D.text_right(F.get(D.file_name_parts(file_like), 1), 4).alias("f12_year"),
        D.try_number(F.col("order_no"), "double").alias("f13_number"),
        D.zero_pad(F.col("order_id") % 100, 3).alias("f14_pad"),
        D.first_of_month(F.lit(1997), (F.col("order_id") % 14).cast("int")).alias("f15_first"),
        F.coalesce("sale_type", F.lit("")).alias("f16_fill"),
        D.composite_key("order_no", "file_no", "sale_type").alias("f17_key"),
        D.label_concat("salesperson", "sale_type").alias("f18_label"),
        D.month_text((F.col("order_id") % 15).cast("string")).alias("f19_month_text"),
        F.replace(F.coalesce("sale_type", F.lit("")), F.lit("-"), F.lit("00")).alias("f20_replace"),
        F.upper(F.trim(F.coalesce("sale_type", F.lit("")))).alias("f21_upper"),
        D.starts_with_total(F.col("order_no")).alias("f22_starts"),
        F.col("sale_type").contains("LOW").alias("f22_contains"),
        D.accounting(F.col("gp3")).alias("f24_accounting"),
        D.percent_text(D.safe_pct("gp1", "gp2")).alias("f25_percent"),
        D.month_label((F.col("order_id") % 13).cast("string")).alias("f26_month"),
        D.sign_class(F.col("gp3")).alias("f27_sign"),
        D.to_int(F.col("file_no") % 100000).alias("f28_int"),
    )
