from pagelake.sources.sitemap import read_sitemap

URLSET = """<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">
<url><loc>https://ex.com/a</loc></url><url><loc>https://ex.com/b</loc></url><url><loc> </loc></url>
<url><loc>https://ex.com/c</loc></url></urlset>"""
INDEX = """<?xml version="1.0"?><sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">
<sitemap><loc>https://ex.com/s1.xml</loc></sitemap><sitemap><loc>https://ex.com/missing.xml</loc></sitemap>
</sitemapindex>"""


def test_urlset_and_index(spark):
    snaps = spark.createDataFrame([("https://ex.com/s1.xml", URLSET), ("https://ex.com/index.xml", INDEX)],
                                  "url string, body string")
    seeds = spark.createDataFrame([("https://ex.com/index.xml",)], "url string")
    got = sorted(r.url for r in read_sitemap(snaps, seeds).collect())
    assert got == ["https://ex.com/a", "https://ex.com/b", "https://ex.com/c"]
