"""Bundles of summaries, and their Markdown and HTML. Only small, limited results are brought together here."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import ranking, relational, traversal
from loomgraph.schema import GraphTables, page


def overview(g: GraphTables, top: int = 10, communities: int = 5, api: int = 15) -> dict[str, DataFrame]:
    """What a newcomer should see: totals, languages, ranked symbols, communities of three or more, public symbols."""
    return {
        "stats": relational.graph_stats(g),
        "languages": relational.breakdown(g.symbols, "language"),
        "important": ranking.ranking(g, top),
        "communities": ranking.community_sizes(ranking.communities(g), 3).limit(communities),
        "api": relational.api_surface(g, limit=api).select("qualified_name", "kind", "file_path", (F.col("start_line") + 1).alias("line")),
    }


def health(g: GraphTables, limit: int = 20) -> dict[str, DataFrame]:
    """What may need work: cycles, unused symbols, untested public symbols, tight coupling, hubs and unsure edges."""
    n = page(limit)
    return {
        "stats": relational.graph_stats(g),
        "confidence": relational.confidence_stats(g),
        "cycles": traversal.cycles(g).orderBy("length", "cycle").limit(n),
        "unused": relational.unused_symbols(g).select("qualified_name", "kind", "file_path").limit(n),
        "untested": relational.coverage_gaps(g, limit=n).select("qualified_name", "kind", "file_path"),
        "coupling": relational.file_coupling(g, n),
        "hubs": relational.hub_symbols(g, n).select("qualified_name", "kind", "in_degree", "out_degree", "total"),
    }


def symbol_details(g: GraphTables, name: str, limit: int = 50) -> dict[str, DataFrame]:
    """The symbols of a name with the edges of each direction."""
    found = relational.symbols_by_name(g, name)
    ids = found.select("id")
    out = g.relationships.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").orderBy("source_id", "target_id", "kind").limit(page(limit))
    into = g.relationships.join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi").orderBy("target_id", "source_id", "kind").limit(page(limit))
    return {"symbols": found, "outgoing": out, "incoming": into}


def markdown(title: str, parts: dict[str, DataFrame], rows: int = 50) -> str:
    """Tables of at most ``rows`` rows each."""
    out = [f"# {title}"]
    for name, df in parts.items():
        out += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        out += ["| " + " | ".join(str(v).replace("|", "\\|").replace("\n", " ") for v in r) + " |" for r in df.take(rows)]
    return "\n".join(out) + "\n"


def page_of_graph(title: str, nodes: DataFrame, edges: DataFrame, n: int = 500) -> str:
    """A page that draws the first n nodes by id on a circle, with the edges between them."""
    few = [r.asDict() for r in nodes.orderBy("id").limit(page(n, 2000)).select("id", "name", "kind").collect()]
    ids = nodes.sparkSession.createDataFrame([(r["id"],) for r in few] or [("",)], "id string")
    own = edges.join(F.broadcast(ids.withColumnRenamed("id", "source_id")), "source_id", "left_semi").join(F.broadcast(ids.withColumnRenamed("id", "target_id")), "target_id", "left_semi")
    links = [list(r) for r in own.select("source_id", "target_id").distinct().orderBy("source_id", "target_id").limit(5000).collect()]
    data = json.dumps({"nodes": few, "links": links}).replace("</", "<\\/")
    script = (
        "const d=JSON.parse(document.getElementById('data').textContent),c=document.querySelector('svg'),at={};"
        "const put=(n,a,t)=>{const e=document.createElementNS('http://www.w3.org/2000/svg',n);for(const k in a)e.setAttribute(k,a[k]);if(t){const x=document.createElementNS('http://www.w3.org/2000/svg','title');x.textContent=t;e.append(x)}c.append(e)};"
        "d.nodes.forEach((n,i)=>{const w=2*Math.PI*i/d.nodes.length;at[n.id]=[400+370*Math.cos(w),400+370*Math.sin(w)]});"
        "d.links.forEach(([a,b])=>put('line',{x1:at[a][0],y1:at[a][1],x2:at[b][0],y2:at[b][1],stroke:'#bbb'}));"
        "d.nodes.forEach(n=>put('circle',{cx:at[n.id][0],cy:at[n.id][1],r:4,fill:'#4e79a7'},n.kind+' '+n.name));"
    )
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title></head><body><svg viewBox="0 0 800 800"></svg><script type="application/json" id="data">{data}</script><script>{script}</script></body></html>'
