"""Training-data operators: decontamination, near-duplicates, URL and quality filters, personal
data, chat formatting, language and licence detection, mixing. Nothing outside this subpackage
(but the pipeline script and the entry module) imports it."""
