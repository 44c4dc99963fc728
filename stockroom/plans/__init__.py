"""Reports and jobs, one module per business area."""
