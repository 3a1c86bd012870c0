import json
import re

from loomgraph.operators import report
from loomgraph.sources import sinks, warehouse


def test_bundles(spark, sf):
    g = warehouse.graph(spark, sf)
    text = report.markdown("Health", report.health(g, 5))
    assert text.startswith("# Health") and text.count("\n## ") == 7
    parts = report.overview(g)
    assert parts["stats"].first().symbols == 200 and parts["api"].count() == 15
    name = g.symbols.first().name
    assert report.symbol_details(g, name)["symbols"].count() >= 1
    nodes, edges = sinks.parts(g)
    page = report.page_of_graph("a <b>", nodes, edges, 50)
    data = json.loads(re.search(r'id="data">(.*?)</script>', page)[1])
    assert len(data["nodes"]) == 50 and "<b>" not in page.split("</title>")[0]
