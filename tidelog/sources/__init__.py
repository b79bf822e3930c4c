"""tidelog.sources"""
