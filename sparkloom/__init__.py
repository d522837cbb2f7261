"""sparkloom: text, mention and corpus analytics as Spark DataFrame operators."""
