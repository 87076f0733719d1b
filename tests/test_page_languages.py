import duckdb

import __spark_entry__ as entry


def test_pages_without_sections_count(spark, tmp_path):
    long = "<p>" + "A page has many words to say. " * 20 + "</p>"
    pages = [
        (1, f'<html lang="de"><body>{long}</body></html>'), (2, '<html lang="de"><body><p>Kurz.</p></body></html>'), (3, '<html lang="fr"><body></body></html>'),
        (4, f"<html><body>{long}</body></html>"), (5, ""), (6, None), (7, f'<html lang="pt-BR"><body>{long}</body></html>'), (8, f'<HTML LANG="en"><body>{long}</body></html>'), (8, '<html lang="es">')]
    spark.createDataFrame([(i, "http://a/b", h) for i, h in pages], "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    want = duckdb.connect().execute(entry.oracle_sql()["page_languages"].replace("FROM pages", f"FROM '{tmp_path}/pages.parquet/*.parquet'")).fetchall()
    got = [tuple(r) for r in entry.queries()["page_languages"](spark, str(tmp_path)).select("language", "n").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and sum(n for _, n in got) == len(pages)
