"""Relations derived from the shared tables, in SQL that Spark and DuckDB read alike.

The tables hold no legal text, so legal lines are built from order lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources import shared

NUMERALS = "一 二 三 四 五 六 七 八 九 十 十一 十二 十三 十四 十五 十六 十七 十八 十九 二十 二十一 二十二 二十三 二十四 二十五 二十六 二十七 二十八 二十九 三十"

LEX_LINES = f"""
SELECT doc_id, ln AS line_no,
  CASE WHEN ln = 1 AND doc_id % 7 = 3 THEN '公布说明'
    WHEN ln = 1 THEN '第' || num || '章 总则'
    WHEN k = 0 THEN '（' || num || '）登记；'
    WHEN k = 1 THEN '第' || num || '条之二 依照《民法典》第' || num || '条第二款。'
    WHEN k = 2 THEN CAST(ln AS varchar(9)) || '. 编号项'
    WHEN k = 3 THEN '普通正文，参照《刑法》第三条。'
    WHEN k = 4 THEN '第' || num || '条为了'
    WHEN k = 5 THEN '第' || num || '节 一般规定'
    WHEN k = 6 THEN num || '、小节'
    ELSE '第' || num || '条 为了规范管理。' END AS text,
  CAST(1 + (ln - 1 - (ln - 1) % 3) / 3 AS int) AS page_num, CAST(50 + 12 * s AS double) AS x0, CAST(10 * ln AS double) AS y0
FROM (
  SELECT l_orderkey AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS int) AS ln,
    split_part('{NUMERALS}', ' ', CAST(l_partkey % 30 + 1 AS int)) AS num, l_partkey % 9 AS k, l_suppkey % 2 AS s
  FROM lineitem
) t
"""

NUMBERED = """
  SELECT l_orderkey AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS int) AS ln, l_partkey, l_suppkey
  FROM lineitem
"""

#: lines of every kind, and some that nearly are
KINDS = (
    "第一编 总则|第二编总则|第三编|第十章 附则|第十章附则|第二节 规定|第一条 甲|第一条之二 乙|第一条甲|（一）登记|(12) 编号|3、编号|a) 项|（B）项|ab) 项|"
    "前言|序：|自序|导论:|第二版序|前言部分|后记|跋语|附录|附录一|附录 12|附录甲|一、小节|十二．小节|十三|"
    "原告：张三|被告:李四|原告张三|再审申请人：王五|上诉人赵六诉称|第三人某某公司诉称不服|本院依法组成合议庭|法院于查明|本院认为|依照《民法典》第五条规定如下：|判决如下|根据事实裁定如下:|依照规定|"
    "审判长 王五|书记员：赵六|代理审判员钱七|审判长|陪审员　孙八|① 参见前注|[12] 同上|12] 同上|⑩|参见《民法典》《刑法》与《某某管理条例》|《实施细则》和《解释》|正文"
)
KIND_LINES = f"""
SELECT split_part('{KINDS}', '|', CAST(l_partkey % {KINDS.count("|") + 1} + 1 AS int)) AS text FROM lineitem
"""

#: judgments of some lines
JUDGED = "原告：张三|被告：李四|本院经审理查明，双方有约|本院认为，应当支付|依照《民法典》第五条规定，判决如下：|一、被告支付|二、驳回其他请求|审判长 王五|书记员 赵六|（一）登记|第三条 引用|正文一行|原告：张三"
JUDGED_LINES = f"""
SELECT doc_id, ln AS line_no, CASE WHEN ln = 1 AND doc_id % 3 = 0 THEN '某某人民法院' ELSE split_part('{JUDGED}', '|', CAST(l_partkey % {JUDGED.count("|") + 1} + 1 AS int)) END AS text,
  CAST(1 + (ln - 1 - (ln - 1) % 3) / 3 AS int) AS page_num, CAST(50 + 12 * (l_suppkey % 2) AS double) AS x0, CAST(10 * ln AS double) AS y0
FROM ({NUMBERED}) t
"""

#: text of a first page from an order
META_PAGES = """
SELECT o_orderkey AS doc_id,
  CASE CAST(o_orderkey % 5 AS int)
    WHEN 0 THEN '中华人民共和国管理条例' || chr(10) || '国务院令第' || CAST(o_custkey AS varchar(20)) || '号' || chr(10) || d || '公布 ' || d || '施行' || chr(10) || '第一条 为了管理。'
    WHEN 1 THEN '最高人民法院关于审理案件的解释' || chr(10) || '法释〔2020〕' || CAST(o_custkey AS varchar(20)) || '号' || chr(10) || d
    WHEN 2 THEN '北京市人民法院民事判决书' || chr(10) || '（2023）京0105民初' || CAST(o_custkey AS varchar(20)) || '号' || chr(10) || '原告：张三' || chr(10) || d
    WHEN 3 THEN '要件事实讲义' || chr(10) || '某某大学出版社' || chr(10) || 'ISBN 978-7-' || CAST(1000 + o_custkey AS varchar(20)) || '-1' || chr(10) || d
    ELSE '普通文件' || chr(10) || '没有结构的正文' END AS page
FROM (
  SELECT o_orderkey, o_custkey, CAST(2000 + o_custkey % 20 AS varchar(4)) || '年' || CAST(1 + o_orderkey % 12 AS varchar(2)) || '月' || CAST(1 + o_custkey % 28 AS varchar(2)) || '日' AS d FROM orders
) t
"""

#: first pages of judgments of several courts and of books whose second line may tell an author
BOOK_PAGES = """
SELECT o_orderkey AS doc_id,
  CASE CAST(o_orderkey % 2 AS int)
    WHEN 0 THEN split_part('中华人民共和国最高人民法院|上海市人民法院|某某县人民法院', '|', CAST(o_custkey % 3 + 1 AS int)) || split_part('民事判决书|刑事裁定书|执行通知书|民事起诉状', '|', CAST(o_custkey % 4 + 1 AS int))
    ELSE '要件事实讲义' || chr(10) || split_part('王|伊藤滋夫 著|某某大学出版社|张三、李四 编|ISBN 978-7-1-1', '|', CAST(o_custkey % 5 + 1 AS int)) END || CASE WHEN o_orderkey % 2 = 0 AND o_custkey % 5 < 2 THEN '' ELSE chr(10) || '某某出版社' || chr(10) || '正文' END AS page
FROM orders
"""


def relation(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    return spark.sql(substituted(sql, tables), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def order_lines(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A relation of lines numbered in each order, dealt by the order before: all later steps of a document share that exchange."""
    return spark.sql(substituted(sql, ("lineitem",)), lineitem=shared.dealt(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_orderkey"))


def substituted(sql: str, tables: tuple[str, ...]) -> str:
    for t in tables:
        sql = sql.replace(f"FROM {t}\n", f"FROM {{{t}}}\n").replace(f"FROM {t})", f"FROM {{{t}}})").replace(f"FROM {t} ", f"FROM {{{t}}} ")
    return sql
