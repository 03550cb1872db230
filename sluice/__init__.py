"""A pipe-query analytics engine on Spark: a query names a table and sends it through stages."""
