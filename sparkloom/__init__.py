"""sparkloom: hybrid code-fragment search as Spark DataFrame plans."""
