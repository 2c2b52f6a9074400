"""bazaarscope: marketplace analytics expressed as Spark DataFrame plans."""
