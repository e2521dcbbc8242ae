"""weftgraph: knowledge-graph and text-corpus analytics written as Spark jobs."""
