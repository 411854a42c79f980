"""Search, graph, suggestion, log and report operators over vault frames."""
